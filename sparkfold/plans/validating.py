"""Queries of validation: JSON Schema keyword by keyword, XML Schema, over documents built from orders and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import validate as V
from .registry import query

_ORDER = {
    "$defs": {"money": {"type": "number", "exclusiveMinimum": 0, "maximum": 400000}, "line": {"type": "object", "required": ["part", "n"], "properties": {"part": {"type": "integer"}, "n": {"type": "integer", "minimum": 1, "maximum": 40}}, "additionalProperties": False}},
    "type": "object", "required": ["key", "status"],
    "properties": {"key": {"type": "integer"}, "status": {"enum": ["O", "F"]}, "price": {"$ref": "#/$defs/money"}, "priority": {"pattern": "^[1-4]-"}, "date": {"format": "date"}, "lines": {"type": "array", "maxItems": 5, "uniqueItems": True, "items": {"$ref": "#/$defs/line"}}},
}
_PARTS = {
    "kinds": {"properties": {"key": {"type": "integer"}, "price": {"type": "number"}}}, "needed": {"required": ["key", "status"]}, "listed": {"properties": {"status": {"enum": ["O", "F"]}}}, "bounds": {"properties": {"price": {"exclusiveMinimum": 0, "maximum": 400000}}},
    "pattern": {"properties": {"priority": {"pattern": "^[1-4]-"}}}, "few": {"properties": {"lines": {"maxItems": 5}}}, "each": {"properties": {"lines": {"items": _ORDER["$defs"]["line"]}}}, "one_of": {"oneOf": [{"properties": {"key": {"multipleOf": 2}}}, {"properties": {"key": {"multipleOf": 3}}}]},
    "closed": {"patternProperties": {"^(key|status|pri)": True}, "properties": {"date": True, "lines": True}, "additionalProperties": False}, "implied": {"if": {"properties": {"status": {"const": "F"}}, "required": ["status"]}, "then": {"required": ["price"]}},
}


@query("""WITH lines AS (SELECT l_orderkey, count(*) AS n, bool_and(l_quantity BETWEEN 1 AND 40) AS each, count(*) = count(DISTINCT (l_linenumber, CAST(l_quantity AS INTEGER))) AS differ FROM lineitem GROUP BY l_orderkey),
o AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p, o_orderpriority AS q, coalesce(n, 0) AS n, coalesce(each, true) AS each, coalesce(differ, true) AS differ FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey),
v AS (SELECT k, k % 11 > 0 AS kinds, k % 7 > 0 AS needed, k % 7 = 0 OR s IN ('O', 'F') AS listed, k % 11 = 0 OR k % 5 = 0 OR p <= 400000 AS bounds, q[1] <> '5' AS pattern, n <= 5 AS few, each, (k % 2 = 0) <> (k % 3 = 0) AS one_of, k % 13 > 0 AS closed, k % 7 = 0 OR s <> 'F' OR k % 5 > 0 OR k % 11 = 0 AS implied, differ FROM o)
SELECT * EXCLUDE (differ), kinds AND needed AND listed AND bounds AND pattern AND few AND each AND differ AS whole FROM v""")
def m21_json_schema(t):
    """Orders as documents, some with a price in quotes, without a status or price, or with a property of their own; one verdict for each keyword."""
    k = F.col("o_orderkey")
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("part"), F.col("l_quantity").cast("int").alias("n"))).alias("lines"))
    rows = t("orders").join(lines, "o_orderkey", "left")
    # a null field is not written
    price = F.when(k % 11 == 0, F.to_json(F.struct(F.col("o_totalprice").cast("string").alias("price")))).when(k % 5 == 0, F.lit("{}")).otherwise(F.to_json(F.struct(F.col("o_totalprice").alias("price"))))
    rest = F.to_json(F.struct(F.when(k % 7 > 0, F.col("o_orderstatus")).alias("status"), F.col("o_orderpriority").alias("priority"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.coalesce("lines", F.array().cast("array<struct<part:int,n:int>>")).alias("lines"), F.when(k % 13 == 0, F.lit("x")).alias("extra")))
    inner = lambda c: F.regexp_replace(c, r"^\{|\}$", "")
    text = F.concat(F.lit("{"), F.array_join(F.filter(F.array(F.concat(F.lit('"key": '), k.cast("string")), inner(price), inner(rest)), lambda x: x != ""), ", "), F.lit("}"))
    made = rows.select(k.alias("k"), text.alias("text"))
    checks = [V.fits_json(s)(F.col("text")).alias(n) for n, s in _PARTS.items()]
    return made.select("k", *checks, V.fits_json(_ORDER)(F.col("text")).alias("whole"))


_PART = {"name": "text", "size": "int 1..40", "brand?": "Brand#1|Brand#2|Brand#3|Brand#4|Brand#5|Brand#11|Brand#12|Brand#13", "price?": {"=": "number", "@currency": "text"}, "made?": "date"}


@query("""SELECT p_partkey, p_size BETWEEN 1 AND 40 AND p_partkey % 7 > 0 AND p_partkey % 11 > 0 AND p_partkey % 13 > 0 AND p_partkey % 17 > 0 AND p_partkey % 19 > 0
AND (p_partkey % 3 > 0 OR p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5', 'Brand#11', 'Brand#12', 'Brand#13')) AS valid FROM part""")
def m22_xml_schema(t):
    """Parts as documents with one fault each: a wrong type or value, an element too many or unknown, one that is missing, an attribute left out."""
    k, name = F.col("p_partkey"), F.concat(F.lit("<name>"), F.col("p_name"), F.lit("</name>"))
    size = F.concat(F.lit("<size>"), F.when(k % 11 == 0, F.lit("large")).otherwise(F.col("p_size").cast("string")), F.lit("</size>"))
    price = F.concat(F.when(k % 13 == 0, F.lit("<price>")).otherwise(F.lit("<price currency='x'>")), F.col("p_retailprice").cast("string"), F.lit("</price>"))
    made = F.when(k % 17 == 0, F.lit("<made>1999-02-30</made>")).otherwise(F.lit("<made>1999-02-28</made>"))
    brand = F.when(k % 3 == 0, F.concat(F.lit("<brand>"), F.col("p_brand"), F.lit("</brand>"))).otherwise(F.lit(""))
    body = F.concat(made, F.when(k % 7 == 0, F.lit("")).otherwise(name), size, price, brand, F.when(k % 19 == 0, name).otherwise(F.lit("")))
    # a part that lacks its name and has it once more behind is right again
    text = F.concat(F.lit("<part>"), F.when((k % 7 == 0) & (k % 19 == 0), F.concat(body, F.lit("<other/>"))).otherwise(body), F.lit("</part>"))
    return t("part").select("p_partkey", V.fits_xsd("part", _PART)(text).alias("valid"))
