"""Queries of export profiles as data over orders as records, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketlab.operators import profiles as P

#: Columns of the profiles, in SQL that both engines read: profile, ord, key, label, path, required, foreclosure_only, examiner.
_COLUMNS = [
    ("a", 1, "owner", "Owner", "owner.name", True, False, False), ("a", 2, "position", "Lien Position", "target.position", True, True, True), ("a", 3, "amount", 'Amount "USD"', "target.amount", True, True, False),
    ("a", 4, "tags", "Tags", "tags", False, False, False), ("a", 5, "none", "None", "no.such.path", True, False, False), ("b", 2, "owner", "Owner", "owner.name", False, False, False), ("b", 1, "status", "Status", "status", True, False, False),
]
_NESTED = {
    "order_type": "case when o_orderkey % 3 = 0 then 'Foreclosure' else 'Two Owner Search' end", "order_type_state": "case when o_orderkey % 4 > 0 then 'CONFIRMED' else 'UNCONFIRMED' end", "status": "case o_orderkey % 5 when 0 then ' ' when 1 then 'unresolved' else o_orderstatus end",
    "name": "case when o_orderkey % 7 > 0 then concat('Jo \"', o_orderpriority, '\"') end", "name_state": "case o_orderkey % 6 when 0 then 'UNCONFIRMED' when 1 then 'EXAMINER_CONFIRMED' else 'CONFIRMED' end",
    "position": "case when o_orderkey % 8 > 0 then '1st Lien' else 'Needs review' end", "position_state": "case o_orderkey % 9 when 0 then 'NOT_STATED' when 1 then 'EXAMINER_CONFIRMED' end", "amount": "cast(cast(o_totalprice as decimal(18,2)) as string)", "amount_state": "case when o_orderkey % 10 = 3 then 'UNCONFIRMED' end",
}


def _values(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey as key", "case when o_orderkey % 2 = 0 then 'a' else 'b' end as profile", *[f"{e} as {k}" for k, e in _NESTED.items()])
    record = F.struct("order_type", "order_type_state", "status", F.struct("name", "name_state").alias("owner"), F.struct("position", "position_state", "amount", "amount_state").alias("target"), F.array(F.lit("x"), F.col("status")).alias("tags"))
    return P.values(o.select("key", "profile", record.alias("record")), spark.createDataFrame(_COLUMNS, P.COLUMNS))


def profile_lines(spark, d):
    return P.lines(_values(spark, d))


def profile_objects(spark, d):
    return P.objects(_values(spark, d))


def profile_warnings(spark, d):
    return P.warnings(_values(spark, d))


QUERIES = {f.__name__: f for f in (profile_lines, profile_objects, profile_warnings)}

_O = f"o as (select o_orderkey \"key\", o_orderkey%2=0 a, {', '.join(f'{e} as {k}' for k, e in _NESTED.items())} from orders)"


def _cell(x: str) -> str:
    return f"'\"'||replace(coalesce({x},''),'\"','\"\"')||'\"'"


_TAGS = "'x | '||status"
_MISS = "coalesce(trim({0}),'')='' or lower(trim({0})) in ('needs review','unresolved')"
_FORE = "(order_type='Foreclosure' and order_type_state='CONFIRMED')"


def _warn(col: str, label: str, value: str, state: str, cond: str, ok: str = "'CONFIRMED'") -> str:
    return f"select \"key\", '{col}' \"column\", case when {_MISS.format(value)} then 'required export field {label} is unresolved.' else 'required export field {label} is not source-confirmed ('||{state}||').' end message from o where {cond} and ({_MISS.format(value)} or {state} not in ({ok}))"


ORACLES = {
    "profile_lines": f"with {_O} select \"key\", case when a then {_cell('name')}||','||{_cell('position')}||','||{_cell('amount')}||','||{_cell(_TAGS)}||',\"\"' else {_cell('status')}||','||{_cell('name')} end line from o",
    "profile_objects": f"with {_O} select \"key\", case when a then '{{\"owner\":'||coalesce(to_json(name)::varchar,'null')||',\"position\":'||to_json(position)||',\"amount\":'||to_json(amount)||',\"tags\":'||to_json({_TAGS})||',\"none\":null}}' else '{{\"status\":'||to_json(status)||',\"owner\":'||coalesce(to_json(name)::varchar,'null')||'}}' end json from o",
    "profile_warnings": f"with {_O} " + " union all ".join([_warn("owner", "Owner", "name", "name_state", "a"), _warn("position", "Lien Position", "position", "position_state", f"a and {_FORE}", "'CONFIRMED','EXAMINER_CONFIRMED'"), _warn("amount", 'Amount "USD"', "amount", "amount_state", f"a and {_FORE}"), "select \"key\", 'none', 'required export field None is unresolved.' from o where a", _warn("status", "Status", "status", "null", "not a")]),
}
