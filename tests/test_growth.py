"""Steps whose cost must not grow faster than the input: keys, readers, pages, files, dimensions, imputation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rentalytics.functions.scalars import key_number
from rentalytics.operators import cleaning as K
from rentalytics.operators import imputation as I
from rentalytics.operators import warehouse as W
from rentalytics.plans.catalog import QUERIES
from rentalytics.sources import readers as R
from rentalytics.sources import writers as O
from rentalytics.sources.binding import listing_pages, listings, table


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("kind, values", [
    ("int", [0, 1, -7, 2147483647, None]),
    ("boolean", [True, False, None]),
    ("double", [0.0, -0.0, 1.0, 2.5, -3.25, 0.1, 1e15, 1.5e15, 999999999999999.0, 1e300, 1e-7,
                float("nan"), float("inf"), float("-inf"), None]),
])
def test_key_texts_by_type_equal_the_general_ones(spark, kind, values):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    got = df.select(key_number("v", kind).alias("a"), key_number("v").alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]


def test_keys_of_typed_columns_take_no_way_through_text(spark):
    df = spark.createDataFrame([(1, 0, None, 1, 1, 0)], ", ".join(f"{a} int" for a in W.DIMENSIONS["dim_amenities"][1]))
    plan = W.build_dim(df, "dim_amenities")._jdf.queryExecution().optimizedPlan().toString()
    assert "as double" not in plan
    general = df.select(W.dim_key("dim_amenities").alias("amenity_id"))
    assert rows(W.build_dim(df, "dim_amenities").select("amenity_id")) == rows(general)


def test_cells_of_a_wide_file_are_read_one_by_one(spark, tmp_path):
    names = [f.name for f in R.schemas.SOURCE_A.fields]
    cells = {"realSum": ("1e2", "x", "NaN"), "multi": ("1.0", "true", "many"), "room_type": ("NULL", "a", "None")}
    lines = [",".join(names)] + [",".join(cells.get(n, ("",) * 3)[i] for n in names) for i in range(3)]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    df = R.read_source_a(spark, str(tmp_path / "a.csv"))
    assert [(r.realSum, r.multi, r.room_type, r.lat) for r in df.collect()] == [
        (100.0, 1, None, None), (None, 1, "a", None), (None, None, None, None)]
    numbers = [f for f in R.schemas.SOURCE_A.fields if f.dataType.simpleString() != "string"]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lambdafunction") >= len(numbers)  # no long generated method


def test_pages_are_dealt_by_their_number(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").count()
    dealt = listing_pages(spark, sf_dir, spread=True, per_task=20)
    assert dealt.rdd.getNumPartitions() == -(-orders // 20) > spark.sparkContext.defaultParallelism
    assert rows(dealt.select("page_id", F.md5("html"))) == rows(
        listing_pages(spark, sf_dir).select("page_id", F.md5("html")))


def test_ingest_writes_files_by_size(spark, sf_dir, monkeypatch):
    plans = []
    write = O.write_by_city
    monkeypatch.setattr(O, "write_by_city", lambda df, path, **options: (plans.append(options), write(df, path, **options)))
    got = QUERIES["ingest_city_files"](spark, sf_dir)
    assert len(plans) == 2 and not any(p.get("files_per_city") for p in plans)
    assert got.count() == got.select("url").distinct().count() > 0


def test_dimensions_from_one_pass(spark, sf_dir):
    df = listings(spark, sf_dir)
    odd = df.limit(3).withColumns({"city": F.lit(None).cast("string"), "wifi": F.lit(None).cast("int")})
    df = df.unionAll(odd).unionAll(odd)
    one, each = W.dims_at_once(df), W.build_star(df)
    assert set(one) == set(W.DIMENSIONS)
    for name, dim in one.items():
        assert dim.columns == each[name].columns
        assert rows(dim) == rows(each[name]), name
    plan = W.build_fact_joined(df, one)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_partkey#") > 0 and plan.count("Generate") == 0
    assert rows(W.build_fact_joined(df, one)) == rows(W.build_fact(df))


def test_imputation_chunks_change_nothing():
    rng = np.random.default_rng(3)
    donors = rng.normal(size=(300, 6))
    imputer = I.Imputer(tuple("abcdef"), 3, 3, donors.mean(0), donors.std(0), donors)
    values = rng.normal(size=(700, 6))
    values[::2, 3:] = np.nan
    values[::7, 1] = np.nan
    assert I.CHUNK_ROWS * 2000 * 8 <= 1 << 20  # the distances of a chunk fit a core's cache
    assert np.array_equal(imputer.fill(values), imputer.fill(values, 512), equal_nan=True)


def test_staging_file_is_compressed(spark, sf_dir, monkeypatch, tmp_path):
    """the keys are most of the file, and repeat."""
    from rentalytics.plans import catalog

    monkeypatch.setattr(catalog, "stage_path", lambda spark, label: str(tmp_path / label))
    got = QUERIES["load_staging"](spark, sf_dir)
    files = list((tmp_path / "files").glob("part-*"))
    assert got.count() == listings(spark, sf_dir).count()
    assert files and sum(f.stat().st_size for f in files) < 120 * got.count()  # 307 bytes a row as plain text


def test_many_orders_meet_their_customers_first(spark, sf_dir, monkeypatch):
    """lineitem is not shuffled on a column of the orders; the rows are the same."""
    from rentalytics.sources import binding

    columns = ("listing_id", "host_is_superhost", "city", "room_type")
    want = rows(listings(spark, sf_dir, columns))
    monkeypatch.setattr(binding, "ORDERS_TO_SHUFFLE", 0)
    df = listings(spark, sf_dir, columns)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    on = {line.strip(" :+-|"): len(line) - len(line.lstrip(" :+-|")) for line in plan.splitlines() if "Join Inner" in line}
    depth = {key: next(d for text, d in on.items() if key in text) for key in ("c_custkey", "l_orderkey")}
    assert depth["c_custkey"] > depth["l_orderkey"]  # below it
    assert rows(df) == want


def gappy(spark, n=4000, seed=5):
    """Rows of few and of many different values, gaps in helpers and targets, keys that come twice and far rows."""
    rng = np.random.default_rng(seed)
    values = np.c_[rng.integers(0, 40, n) / 8, rng.integers(1, 6, n), rng.normal(size=n).round(2),
                   rng.normal(size=(n, 2)).round(3)].astype(float)
    values[:n // 10, 0] += 60
    values[rng.random(n) < 0.1, 1] = np.nan
    values[rng.random(n) < 0.02, 2] = np.nan
    values[rng.random(n) < 0.1, 3] = np.nan
    values[rng.random(n) < 0.3, 4] = np.nan
    values[:n // 20, 3:] = np.nan
    data = [(i // 2 * 2 if i % 50 == 0 else i, str(i), *[None if np.isnan(x) else float(x) for x in row])
            for i, row in enumerate(values)]
    return spark.createDataFrame(data, "listing_id long, name string, a double, b double, c double, x double, y double")


def filled_rows(df):
    return {r.name: [None if r[c] is None else round(r[c], 9) for c in "abcxy"] for r in df.collect()}


def test_every_complete_row_is_a_donor(spark):
    """the nearest row is found wherever its hash lies."""
    df = spark.createDataFrame([(i, float(i), float(10 * i)) for i in range(6000)] + [(9999, 4321.0, None)],
                               "listing_id long, x double, y double")
    got = I.knn_impute(df, ["y"], ["x"]).filter("listing_id = 9999").first()
    assert got.y == 43210.0
    columns = {c: "double" for c in (*I.DISTANCE_HELPERS, *I.C.DISTANCE_MEASURES)}
    many = spark.range(3001).select(F.col("id").alias("listing_id"), *[
        F.when((F.col("id") < 3000) | F.lit(c in I.DISTANCE_HELPERS), (F.col("id") % 3000).cast(t)).alias(c)
        for c, t in columns.items()])
    many = many.withColumn("realSum", F.when(F.col("listing_id") == 3000, F.lit(1777.0)).otherwise(F.col("realSum")))
    many = many.withColumns({c: F.when(F.col("listing_id") == 3000, F.lit(1777.0)).otherwise(F.col(c))
                             for c in I.DISTANCE_HELPERS})
    assert I.impute_distances(many).filter("listing_id = 3000").first().dist == 1777.0


def test_clean_listings_caps_no_donors():
    import inspect
    assert inspect.signature(I.impute_all).parameters["donors"].default == (None, None, None)


def test_index_equals_all_distances(monkeypatch):
    rng = np.random.default_rng(3)
    donors = np.c_[rng.integers(0, 30, 3000) / 7, rng.integers(0, 5, 3000), rng.normal(size=(3000, 3)).round(2)].astype(float)
    donors[rng.random(3000) < 0.1, 1] = np.nan
    rows = donors[rng.permutation(3000)[:400]] + rng.integers(0, 2, (400, 1))
    rows[:60, 0] += 50
    rows[:, 3:][rng.random((400, 2)) < 0.6] = np.nan
    rows[3] = np.nan
    imputer = I.Imputer(tuple("abcde"), 3, 3, np.nanmean(donors, 0), np.nanstd(donors, 0), donors)
    monkeypatch.setattr(I, "FLAT_DONORS", 10**9)
    want = imputer.fill(rows)
    monkeypatch.setattr(I, "FLAT_DONORS", 0)
    assert np.array_equal(imputer.fill(rows), want, equal_nan=True)


@pytest.mark.parametrize("heavy", [4, 0])
def test_cells_give_what_one_task_gives(spark, monkeypatch, heavy):
    """donors too many for a task are searched in cells, with the same result."""
    from rentalytics.operators import neighbours as N
    from rentalytics.runtime import stage

    df = stage(gappy(spark), "gappy")
    want = filled_rows(I.knn_impute(df, ["x", "y"], ["a", "b", "c"]))
    monkeypatch.setattr(I, "LOCAL_DONORS", 100)
    monkeypatch.setattr(N, "CELL_DONORS", 200)
    monkeypatch.setattr(N, "CELL_ROWS", 150)
    monkeypatch.setattr(N, "HEAVY", heavy)
    out = I.knn_impute(df, ["x", "y"], ["a", "b", "c"])
    got = filled_rows(out)
    assert len(got) == out.count() == 4000
    bad = {k: (got[k], v) for k, v in want.items() if got[k] != pytest.approx(v, abs=1e-8)}
    assert not bad, list(bad.items())[:3]


def test_clean_listings_keeps_one_stage(spark, sf_dir, tmp_path, monkeypatch):
    """a pass's table takes the place of the one before; a table written by others stays."""
    from rentalytics import runtime
    from rentalytics.plans.pipeline import clean_listings
    from rentalytics.sources.binding import source_a, source_b

    monkeypatch.setattr(runtime, "shared_dir", lambda spark: str(tmp_path))
    spark.range(5).write.parquet(str(tmp_path / "mine"))
    one = runtime.stage(spark.range(5).withColumn("x", F.lit(1)), "one")
    two = runtime.restage(one.union(spark.read.parquet(str(tmp_path / "mine")).withColumn("x", F.lit(2))), "two")
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == ["mine", "two"]
    assert two.count() == 10
    out = clean_listings(source_a(spark, sf_dir), source_b(spark, sf_dir))
    left = sorted(p.name for p in tmp_path.iterdir())
    assert [n.rsplit("-", 1)[0] for n in left] == ["impute-distances", "mine", "two"]
    assert out.count() == K.merge_sources(source_a(spark, sf_dir), source_b(spark, sf_dir)).count()
