"""Bookmaker's feed: nested JSON documents flattened to events, prices and packs.

The documents are read with the schemas below (spark.read.schema(...).json), so that nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.odds import milli_line, milli_odds

SCHEMA_VERSION = "1.0.0"
EVENT = "id bigint, name string, start string, state string, `group` string, homeName string, awayName string, path array<struct<id:bigint,name:string,englishName:string,termKey:string>>"
OUTCOME = "struct<id:bigint,label:string,participant:string,participantId:bigint,eventParticipantId:bigint,type:string,line:bigint,odds:bigint,status:string>"
OFFER = f"struct<id:bigint,criterion:struct<id:bigint,label:string>,betOfferType:struct<name:string>,outcomes:array<{OUTCOME}>>"
#: How deep groups of a combination may nest.
DEPTH = 4


def _group(depth: int) -> str:
    inner = f",groups:array<{_group(depth - 1)}>" if depth > 1 else ""
    return f"struct<outcomes:array<struct<id:bigint>>{inner}>"


PACK = f"struct<id:bigint,tags:array<string>,prePackSelections:array<struct<selectionId:bigint,label:array<string>,status:string,combinations:array<struct<odds:struct<decimal:bigint>,groups:array<{_group(DEPTH)}>>>>>>"
RESPONSE = f"event_id bigint, league string, betOffers array<{OFFER}>, prePacks array<{PACK}>"


def events(rows: DataFrame, captured_at: Column) -> DataFrame:
    """One row per event document; path holds sport, country and league."""
    path = F.col("path")
    at = lambda i, field: F.get(path, F.lit(i))[field]
    names = F.split("name", " - ")
    football = F.filter(path, lambda p: p["termKey"] == "football")
    return rows.select(
        F.col("id").alias("event_id"), F.col("name"), F.col("start").alias("start"),
        F.when(F.size(football) > 0, F.get(football, F.lit(0))["englishName"]).otherwise(at(0, "englishName")).alias("sport"),
        at(1, "name").alias("country"), F.coalesce(F.nullif("group", F.lit("")), at(2, "name")).alias("league"), at(2, "termKey").alias("league_key"),
        F.coalesce(F.nullif("homeName", F.lit("")), F.trim(F.get(names, F.lit(0)))).alias("home_name"), F.coalesce(F.nullif("awayName", F.lit("")), F.get(names, F.lit(1))).alias("away_name"),
        F.col("state"), captured_at.alias("captured_at"), F.substring(captured_at, 1, 10).alias("capture_day"), F.lit(SCHEMA_VERSION).alias("schema_version"),
    )


def prices(responses: DataFrame, captured_at: Column) -> DataFrame:
    """One row per outcome with a price.  A market is about a player where the outcome names an event participant."""
    offers = responses.select("event_id", "league", F.explode("betOffers").alias("o"))
    rows = offers.select("event_id", "league", F.col("o.id").alias("offer_id"), F.col("o.criterion.label").alias("market"), F.col("o.criterion.id").alias("market_id"), F.col("o.betOfferType.name").alias("offer_type"), F.explode("o.outcomes").alias("r"))
    odds = milli_odds(F.col("r.odds"))
    return rows.select(
        F.col("r.id").alias("outcome_id"), "offer_id", "event_id", "league", "market", "market_id", "offer_type", F.col("r.label").alias("label"), F.col("r.participant").alias("participant"),
        F.col("r.participantId").alias("participant_id"), F.col("r.eventParticipantId").isNotNull().alias("is_player"), F.col("r.type").alias("outcome_type"), milli_line(F.col("r.line")).alias("line"),
        odds.alias("odds"), F.round(1.0 / odds, 6).alias("implied"), F.col("r.status").alias("status"), captured_at.alias("captured_at"), F.substring(captured_at, 1, 10).alias("capture_day"),
    ).where("odds is not null")


def _leg_ids(group: Column, depth: int) -> Column:
    """A group's own outcomes, then those of the groups within."""
    own = F.coalesce(F.filter(F.transform(group["outcomes"], lambda o: o["id"]), lambda x: x.isNotNull()), F.array().cast("array<bigint>"))
    if depth == 1:
        return own
    inner = F.flatten(F.transform(F.coalesce(group["groups"], F.array().cast(f"array<{_group(depth - 1)}>")), lambda g: _leg_ids(g, depth - 1)))
    return F.concat(own, inner)


def packs(responses: DataFrame, captured_at: Column) -> DataFrame:
    """One row per combination with a price and legs; the hash doesn't depend on the order of the legs."""
    rows = responses.select("event_id", "league", F.explode("prePacks").alias("p")).select("event_id", "league", "p.id", "p.tags", F.explode("p.prePackSelections").alias("s")).select("event_id", "league", F.col("id").alias("pack_id"), "tags", F.col("s.selectionId").alias("selection_id"), F.col("s.label").alias("labels"), F.col("s.status").alias("status"), F.explode("s.combinations").alias("c"))
    ids = F.flatten(F.transform(F.coalesce(F.col("c.groups"), F.array().cast(f"array<{_group(DEPTH)}>")), lambda g: _leg_ids(g, DEPTH)))
    rows = rows.withColumns({"ids": ids, "odds": milli_odds(F.col("c.odds.decimal"))}).where("odds is not null and size(ids) > 0")
    key = F.concat(F.col("event_id").cast("string"), F.lit("|["), F.array_join(F.array_sort("ids"), ", "), F.lit("]"))
    return rows.select("pack_id", "selection_id", F.substring(F.sha2(key, 256), 1, 16).alias("pack_hash"), "event_id", "league", F.size("ids").alias("n_legs"), F.array_join("ids", ",").alias("legs"), "odds", F.array_join("labels", ",").alias("labels"), "status", F.array_join("tags", ",").alias("tags"), captured_at.alias("captured_at"), F.substring(captured_at, 1, 10).alias("capture_day"))


def leagues_with_events(tree: DataFrame, least: int = 1) -> DataFrame:
    """The sport tree (name, groups of countries, groups of leagues with eventCount) as leagues with enough events."""
    rows = tree.select(F.explode("groups").alias("c")).select(F.col("c.name").alias("country"), F.explode("c.groups").alias("l")).select("country", F.col("l.name").alias("league"), F.col("l.termKey").alias("league_key"), F.col("l.eventCount").alias("events"))
    return rows.where(F.col("events") >= least).orderBy(F.col("events").desc(), "country", "league_key")


def first_events(rows: DataFrame, n: int) -> DataFrame:
    """Each event once (the first league it was seen in), the earliest n."""
    once = rows.groupBy("event_id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "event_id"]), F.struct("start", "league")).alias("r")).select("event_id", "r.*")
    return once.orderBy("start", "event_id").limit(n)


def selected_leagues(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Leagues or events whose country and league key are wanted; a key alone isn't unique."""
    return rows.join(F.broadcast(wanted.select("country", "league_key").distinct()), ["country", "league_key"], "left_semi")


def missing_leagues(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """Wanted leagues that the feed doesn't have."""
    return wanted.select("country", "league_key").subtract(rows.select("country", "league_key"))
