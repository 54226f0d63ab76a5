"""Queries of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millweir.llm.canonical import NONE, map_places
from millweir.llm.copies import collapse, find_copies
from millweir.llm.mixing import mix
from millweir.llm.names import business_links, members_of, pairs_of, person_links
from millweir.llm.tokens import decode, encode, sizes
from millweir.llm.truncation import find_truncated, shares
from millweir.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = find_copies(table(spark, d, "sales_reps"), "rep_id", ["email", "phone"])
    return found.where("row_id <> kept_id").select(F.col("kept_id").alias("kept_rep_id"), F.col("row_id").alias("rep_id"))


def p2_collapsed(spark: SparkSession, d: str) -> DataFrame:
    reps = table(spark, d, "sales_reps")
    return collapse(reps, "rep_id", find_copies(reps, "rep_id", ["email", "phone"])).select("rep_id", "email", "phone", "n_copies")


def _named(spark: SparkSession, d: str) -> list[DataFrame]:
    return members_of(business_links(table(spark, d, "dealers"), "dealer_id", "name"), person_links(table(spark, d, "sales_reps"), "rep_id", "dealer_id", "full_name"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    dealers, reps = (pairs_of(m) for m in _named(spark, d))
    named = lambda df, name: df.select(F.lit(name).alias("tbl_name"), "id_a", "id_b")
    return named(dealers, "dealers").unionByName(named(reps, "sales_reps"))


def p3_members(spark: SparkSession, d: str) -> DataFrame:
    """One row a name in a class of several spellings, without the pairs."""
    dealers, reps = (m.select(F.col("id").alias("row_id"), F.col("comp").alias("class_id")) for m in _named(spark, d))
    return dealers.select(F.lit("dealers").alias("tbl_name"), "row_id", "class_id").unionByName(reps.select(F.lit("sales_reps").alias("tbl_name"), "row_id", "class_id"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return map_places(table(spark, d, "dealers"), "dealer_id", "city", "country", table(spark, d, "ref_countries"), table(spark, d, "ref_cities"))


def p4_unmatched(spark: SparkSession, d: str) -> DataFrame:
    dealers = table(spark, d, "dealers").select("dealer_id", F.col("city"), F.col("country"))
    none = p4_found(spark, d).where(F.col("ref_key") == NONE).join(dealers, "dealer_id")
    value = F.when(F.col("field_name") == "city", F.col("city")).otherwise(F.col("country"))
    return none.groupBy("field_name", value.alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"), "doc_id", "text")


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    return decode(p6_ids(spark, d), "doc_id", "ids")


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    return mix(sizes(docs, "doc_id", "text", "source"), "doc_id", "source", table(spark, d, "mix_targets"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def _truncated(spark: SparkSession, d: str) -> DataFrame:
    return find_truncated(table(spark, d, "documents"), "doc_id", "text", ["source", "channel"])


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _truncated(spark, d).where("truncated").select("doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return shares(table(spark, d, "documents"), _truncated(spark, d), "doc_id", "source")


QUERIES = {"p2_found": p2_found, "p2_collapsed": p2_collapsed, "p3_found": p3_found, "p3_members": p3_members, "p4_found": p4_found, "p4_unmatched": p4_unmatched, "p6_ids": p6_ids, "p6_decoded": p6_decoded, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_shares": p8_shares}

_P2 = """
  select rep_id, email, phone, least(a, b) as lo, greatest(a, b) as hi, a <> '' and b <> '' as whole from (
    select rep_id, email, phone, lower(regexp_replace(email, '[^A-Za-z0-9]', '', 'g')) as a, lower(regexp_replace(phone, '[^A-Za-z0-9]', '', 'g')) as b from sales_reps)
"""

ORACLES = {
    "p2_found": f"select kept_rep_id, rep_id from (select min(rep_id) over (partition by lo, hi) as kept_rep_id, rep_id from ({_P2}) where whole) where rep_id <> kept_rep_id",
    "p2_collapsed": f"""
      with x as ({_P2}), g as (select lo, hi, min(rep_id) as kept, count(*) as n from x where whole group by lo, hi)
      select x.rep_id, x.email, x.phone, coalesce(g.n, 1) as n_copies from x left join g on x.whole and x.lo = g.lo and x.hi = g.hi where g.kept is null or g.kept = x.rep_id""",
    "p6_decoded": "select doc_id, coalesce(text, '') as text from documents",
}
