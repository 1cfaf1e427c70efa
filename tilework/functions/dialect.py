"""One statement, two spellings: the few functions that Spark SQL and DuckDB name differently.

RINT[x] rounds half to even, IDIV[a;b] divides whole numbers, PCT[v;p] is the exact interpolated percentile, MAXBY[v;k] the v
of the largest k, ROWS[a;b] an ordered pair, SPLIT[s;c] an array of parts, AT[a;i] its i-th entry from 1, RX[s;p;g] the g-th
group of a pattern (empty if none), RXREP[s;p;r] replaces all matches, DOTS[s] splits at dots."""

from __future__ import annotations

import re

SPARK = {"RINT": "rint({0})", "IDIV": "({0} div {1})", "PCT": "percentile({0}, {1})", "MAXBY": "max_by({0}, {1})", "ROWS": "struct({0}, {1})", "SPLIT": "split({0}, {1})", "AT": "try_element_at({0}, {1})", "RX": "regexp_extract({0}, {1}, {2})", "RXREP": "regexp_replace({0}, {1}, {2})", "DOTS": "split({0}, '\\.')"}
DUCK = {"RINT": "round_even({0}, 0)", "IDIV": "({0} // {1})", "PCT": "quantile_cont({0}, {1}::DOUBLE)", "MAXBY": "arg_max({0}, {1})", "ROWS": "row({0}, {1})", "SPLIT": "string_split({0}, {1})", "AT": "list_extract({0}, {1})", "RX": "regexp_extract({0}, {1}, {2})", "RXREP": "regexp_replace({0}, {1}, {2}, 'g')", "DOTS": "string_split({0}, '.')"}
INNER = re.compile(r"\b([A-Z]+)\[([^\[\]]*)\]")


def spell(statement: str, names: dict[str, str]) -> str:
    before = None
    while before != statement:
        before = statement
        statement = INNER.sub(lambda m: names[m[1]].format(*(x.strip() for x in m[2].split(";"))).replace("[", "\x01").replace("]", "\x02") if m[1] in names else m[0], statement)
    return statement.replace("\x01", "[").replace("\x02", "]")


CORR = re.compile(r"\bcorr\(((?:[^(),]|\([^()]*\))+), ((?:[^(),]|\([^()]*\))+)\)")


def spark_sql(statement: str) -> str:
    """corr becomes its formula with a division that gives null: Spark's own raises an error where a side is constant, even
    inside the CASE that asks for that."""
    return CORR.sub(r"try_divide(covar_pop(\1, \2), stddev_pop(\1) * stddev_pop(\2))", spell(statement, SPARK)).replace("\\", "\\\\")


def duck_sql(statement: str) -> str:
    return spell(statement, DUCK)
