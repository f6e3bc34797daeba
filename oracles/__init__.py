"""DuckDB SQL that states what each registered query must return."""
