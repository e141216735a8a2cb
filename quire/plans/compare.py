"""Compare a Spark query with its DuckDB oracle: rows, column names, value multiset."""

from __future__ import annotations

import datetime as _dt
import decimal
import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame

from quire.sources.tables import BASE_TABLES


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


SPARK_TO_DUCK = {"tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT",
                 "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "date": "DATE",
                 "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE", "boolean": "BOOLEAN"}


def duck_type_of(spark_type: str) -> str:
    """DuckDB spelling of a Spark simpleString type (decimal(p,s) -> DECIMAL(p,s))."""
    if spark_type.startswith("decimal("):
        return spark_type.upper()
    return SPARK_TO_DUCK.get(spark_type, spark_type.upper())


def type_differences(df: DataFrame, con, sql: str) -> dict:
    """{column: (spark type, oracle type)} for columns whose types differ."""
    s = {f.name: duck_type_of(f.dataType.simpleString()) for f in df.schema.fields}
    rel = con.sql(sql)
    o = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    return {c: (s.get(c), o.get(c)) for c in set(s) | set(o) if s.get(c) != o.get(c)}


def _canon(v) -> str:
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, (_dt.datetime, _dt.date)):
        return v.isoformat()
    return str(v)


def _rows_digest(names: list[str], rows) -> tuple[int, str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    canon = sorted("\x1f".join(_canon(r[i]) for i in order) for r in rows)
    h = hashlib.sha256("\n".join(canon).encode()).hexdigest()
    return len(canon), h


@dataclass
class Result:
    name: str
    rows_spark: int
    rows_oracle: int
    names_match: bool
    values_match: bool
    detail: str = ""

    @property
    def ok(self) -> bool:
        return self.names_match and self.values_match and self.rows_spark == self.rows_oracle


def compare(name: str, df: DataFrame, con, sql: str) -> Result:
    s_names = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    o_names = [d[0] for d in cur.description]
    o_rows = cur.fetchall()
    names_ok = sorted(s_names) == sorted(o_names)
    n_s, h_s = _rows_digest(s_names, s_rows)
    n_o, h_o = _rows_digest(o_names, o_rows)
    detail = ""
    if not names_ok:
        detail = f"spark cols {sorted(s_names)} vs oracle {sorted(o_names)}"
    elif h_s != h_o:
        order_s = sorted(range(len(s_names)), key=lambda i: s_names[i])
        order_o = sorted(range(len(o_names)), key=lambda i: o_names[i])
        cs = sorted("|".join(_canon(r[i]) for i in order_s) for r in s_rows)
        co = sorted("|".join(_canon(r[i]) for i in order_o) for r in o_rows)
        only_s = [x for x in cs if x not in set(co)][:3]
        only_o = [x for x in co if x not in set(cs)][:3]
        detail = f"cols {sorted(s_names)} spark-only {only_s} oracle-only {only_o}"
    return Result(name, n_s, n_o, names_ok, h_s == h_o, detail)
