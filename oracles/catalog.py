"""All statements by query name."""

from oracles import analyses, cleaning, pages, statistics

SQL: dict[str, str] = {**analyses.SQL, **cleaning.SQL, **statistics.SQL, **pages.SQL}
