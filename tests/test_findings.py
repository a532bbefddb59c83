"""Claims of a review, each with a small case that failed before."""

import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from touchline.llm import quality_rules
from touchline.operators import entity, features, folds, market, pricing, settlement
from touchline.operators.models import trees
from touchline.plans import crawl_queries, landed_queries, odds_queries, pricing_queries
from touchline.plans.base import nearest
from touchline.plans.fixtures import Tables
from touchline.sources import readers
from touchline.streaming import streams


def test_earliest_row_of_a_key(spark, tmp_path):
    """Rows of a key arrive together or too late, in any order, and the earliest counts."""
    place, got = str(tmp_path / "in"), {}

    def batch(*rows):
        spark.createDataFrame(list(rows), "k int, at int, v string").select("k", F.timestamp_seconds("at").alias("at"), "v").coalesce(1).write.mode("append").parquet(place)
        stream = streams.captures(spark, place, "k int, at timestamp, v string")
        query = streams.earliest(stream, "k", "at").writeStream.foreachBatch(lambda part, _: got.update({r.k: r.v for r in part.collect()})).option("checkpointLocation", str(tmp_path / "state")).outputMode("update").trigger(availableNow=True).start()
        query.awaitTermination()

    batch(*((k, 900 - n, f"{900 - n}") for n in range(300) for k in range(3)), (3, None, "x"))
    assert got == {0: "601", 1: "601", 2: "601", 3: None}
    batch((1, 50, "50"), (2, 999, "999"), (3, 7, "7"))
    assert got == {0: "601", 1: "50", 2: "601", 3: "7"}


def shuffled(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_events_meet_one_result_each(spark):
    """A side's events and results of a day aren't paired with each other."""
    row = (F.col("id") % 2).cast("string").alias("league"), F.lit("2024-05-01").cast("date").alias("day")
    events = spark.range(4000).select(F.col("id").alias("event_id"), *row, F.lit("Team 1").alias("home_name"))
    results = spark.range(4000).select((4000 - F.col("id")).alias("result_id"), *row, F.lit("TEAM 1.").alias("home_name"), F.col("id").alias("goals"))
    before = shuffled(spark)
    got = {(r.event_id % 2, r.result_id, r.goals) for r in entity.results_for(events, results).collect()}
    assert got == {(0, 2, 3998), (1, 1, 3999)} and shuffled(spark) - before < 2_000_000


def test_mean_price_at_the_bound(spark, tmp_path):
    """A leg whose mean price is just 3.35 has no price, in whatever order its odds are added."""
    values = [0.0, 37.0, 16.0, 21.0] * 30 + [18.0, 19.0] * 40
    for k, order in enumerate((values, values[::-1], sorted(values))):
        rows = [(n, n % 2, v) for n, v in enumerate(order)]
        spark.createDataFrame(rows, "event_id long, user_id long, value double").coalesce(1).select("event_id", F.lit(7 * k).cast("long").alias("user_id"), F.lit("m").alias("event_type"), F.timestamp_seconds("event_id").alias("ts"), "value").write.mode("append").parquet(str(tmp_path / "events.parquet"))
    assert odds_queries._leg_prices(Tables(spark, str(tmp_path))).collect() == []


def test_common_words_and_other_lengths(spark):
    """Slugs that share a word and letters with every name aren't compared with them all, and slug and method stay as they were."""
    slugs = spark.range(3000).select(F.concat(F.lit("supplier_"), F.lpad("id", 6, "0")).alias("slug"))
    of = lambda n, c: spark.range(n).select(c.alias("name"))
    number = F.lpad(F.col("id").cast("string"), 6, "0")
    names = of(3000, F.concat(F.lit("Supplier "), number, F.lit(" Real"))).unionByName(of(500, F.concat(F.lit("Zzz "), "id", F.lit("q")))).unionByName(of(1, F.lit("Supplier")))
    names = names.unionByName(of(1, F.lit("Supplierr 00000x7"))).unionByName(of(1, F.lit("plier 000017 supplier")))
    before = shuffled(spark)
    got = {r.name: (r.slug, r.method) for r in entity.resolve(names, slugs, closest=False).collect()}
    assert shuffled(spark) - before < 5_000_000
    assert got["Supplier 000012 Real"] == ("supplier_000012", "subconjunto") and got["Zzz 12q"] == (None, "sin_coincidencia")
    assert got["Supplier"] == (None, "subconjunto_ambiguo:3000") and got["plier 000017 supplier"] == ("supplier_000017", "subconjunto")
    few = spark.createDataFrame([(x,) for x in ("Supplierr 000007", "Suplier 00007", "Supplier", "Zzz 1", "Supplier 000001 Real", "plier 000017 supplier")], "name string")
    pick = lambda closest: {tuple(r) for r in entity.resolve(few, slugs.limit(400), closest=closest).select("name", "slug", "method").collect()}
    assert pick(False) == pick(True)


def test_scores_of_one_file_are_priced_in_several_tasks(spark):
    rates = spark.range(0, 100, 1, 1).selectExpr("id AS match_id", "1.2D AS lam", "0.9D AS mu")
    parts = pricing.price(pricing.score_rows(rates), pricing.Catalogue().result()).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 4 and sum(r["count"] for r in parts) == 300


def test_nearest_is_round(spark):
    values = [None, 0.0, -0.0, 1e-7, 0.0000005, 0.1234565, 2.5, -2.5, 0.00049999999, 1e18, -1e300, float("nan"), float("inf"), 1000.5, 998.99999949999, *(k * 5e-7 for k in range(-300, 300)), *(k / 7 for k in range(-300, 300))]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (4, 6, 8):
        got = rows.select(nearest(F.col("v"), digits).alias("a"), F.round("v", digits).alias("b")).where("NOT a <=> b")
        assert got.count() == 0


def test_sums_of_trees_travel_as_few_rows(spark):
    """What a pass shuffles follows from groups and classes, not from tasks and cells."""
    values = [((F.col("id") * (k + 3)) % 97).cast("double").alias(f"f{k}") for k in range(12)]
    rows = spark.range(0, 8000, 1, 64).select(F.lit("a").alias("group"), F.when(F.col("id") % 5 == 0, "val").otherwise("train").alias("split"), (F.col("id") * 7 % 11 % 3).alias("y"), *values)
    before = shuffled(spark)
    trees.fit(rows, "group", [f"f{k}" for k in range(12)], growth=trees.Growth(rounds=2, depth=3))
    assert shuffled(spark) - before < 5_000_000


def test_only_one_day_of_a_fold_is_ordered(spark):
    """A fold's last rows validate, whatever the days they fall on."""
    at = F.timestamp_seconds(F.lit(1_000_000_000) + F.col("id") % 40 * 43_200 + F.when(F.col("id") % 4 == 0, 100 * 86_400).otherwise(0))
    rows = spark.range(4000).select(F.col("id").alias("match_id"), at.alias("kickoff"), F.when(F.col("id") % 4 == 0, 2).otherwise(1).alias("season"))
    split = folds.season_folds(rows, first=1, least=10, least_validation=333)
    past = sorted(((r.kickoff, r.match_id) for r in rows.where("season = 1").collect()), reverse=True)
    got = {r.match_id: r.split for r in split.collect()}
    assert {k for k, s in got.items() if s == "val"} == {m for _, m in past[:450]} and sum(s == "test" for s in got.values()) == 1000


def test_lines_and_legs_of_one_file_are_made_in_several_tasks(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    for made in (pricing_queries.q_line_periods(t), pricing_queries.q_line_values(t), pricing_queries.q_settle_legs(t)):
        assert made.select(F.spark_partition_id().alias("p")).distinct().count() == 4


def test_batches_of_pages_are_bounded(spark):
    """A worker gets a few MB of pages at once, not all of a task's."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    crawl_queries.q_page_text(Tables(spark, "/root/testdata/sf0.001"))
    rows = spark.range(0, 3000, 1, 1).select(F.concat(F.repeat(F.lit("x"), 20_000), F.col("id").cast("string")).alias("html"))
    most = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").agg(F.max("n")).first()[0]
    assert most < 1000


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fixed_leagues_are_broadcast(spark):
    """Orders aren't gathered and sorted by league."""
    assert "SortMergeJoin" not in planned(landed_queries.q_league_levels(Tables(spark, "/root/testdata/sf0.001")))


def test_slugs_of_csvs_are_made_once(spark, tmp_path):
    """Filters on slugs and keys don't repeat their expressions, and no pattern is searched in a row's path."""
    (tmp_path / "E0.csv").write_text("Date,Time,HomeTeam,AwayTeam,FTHG,FTAG,FTR\n01/02/2024,15:00,Real Madrid,Valencia CF,2,1,H\n")
    rows = readers.matches_from_csv(readers.csv_rows(spark, str(tmp_path / "*.csv")))
    made = rows._jdf.queryExecution().optimizedPlan().toString()
    assert made.count("translate(") <= 2 and "regexp_extract(input_file_name()" not in made
    assert [(r.league, r.season, r.home_goals) for r in rows.collect()] == [("E0", "2023-24", 2)]


def test_legs_are_made_where_their_scores_arrive(spark):
    """Events are shuffled to their scores, not the legs that are made of them."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = planned(pricing_queries.q_settle_tickets(Tables(spark, "/root/testdata/sf0.001")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    between = plan[plan.index("SortMergeJoin") : plan.index("BroadcastNestedLoopJoin")]
    assert "Exchange" not in between


def test_events_of_tickets_are_gathered_before_their_legs(spark):
    """The ledger's arrays are made from gathered events; its text is read before the legs are made."""
    plan = planned(pricing_queries.q_ledger_summary(Tables(spark, "/root/testdata/sf0.001")))
    assert 0 < plan.index("BroadcastNestedLoopJoin") < plan.index("collect_list(")


def test_all_labelled_documents_set_the_threshold(spark):
    """Labels beyond any sample's size are counted."""
    docs = spark.range(0, 7000, 1, 4).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda k: F.concat(F.lit("w"), (F.col("id") * 7 + k).cast("string"))), " ").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    assert quality_rules.labelled_ratios(docs, labels).count() == 7000
    assert quality_rules.fit_rules(docs, labels)[1] <= 1


def test_pack_with_several_prices_costs_the_highest(spark):
    """As in the SQL, and not the price that happens to come first."""
    prices = spark.createDataFrame([(1, "2024", 2.0), (2, "2024", 3.0)], "outcome_id long, captured_at string, odds double")
    for odds in ((5.0, 7.0, 6.0), (7.0, 5.0, 6.0)):
        packs = spark.createDataFrame([(9, "2024", "1,2", x) for x in odds], "pack_id long, captured_at string, legs string, odds double").coalesce(1)
        assert [(r.n_legs, r.pack_odds, r.product) for r in market.combination_cost(packs, prices).collect()] == [(6, 7.0, 216.0)]


def test_a_log_is_rolled_once_and_over_borders_of_batches(spark):
    """Both teams' features come from one pass, and days that reach over Arrow batches give what a loop over a team's matches gives."""
    draw = np.random.default_rng(5)
    goals = [None if k % 9 == 4 else int(v) for k, v in enumerate(draw.integers(0, 5, 400))]
    rows = [(k, "A", datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=int(k) // 2), f"t{k % 3}", f"u{k % 2}", goals[k], None if goals[k] is None else k % 4) for k in range(400)]
    df = spark.createDataFrame(rows, "match_id long, league string, kickoff timestamp, home string, away string, home_goals int, away_goals int")
    made = features.match_features(df)
    assert planned(made).count("MapInArrow") == 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.match_id: (r.home_prior, r.home_gf_5, r.home_gf_10, r.away_ga_10) for r in made.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    mean = lambda x: sum(x) / len(x) if x else None
    own = lambda k, side: [r[5] for r in rows[:k] if r[side] == rows[k][side] and r[5] is not None]
    want = {k: (len(own(k, 3)), mean(own(k, 3)[-5:]), mean(own(k, 3)[-10:]), mean(own(k, 4)[-10:])) for k in range(400)}
    assert got == want


def test_edges_of_bins_come_from_points(spark):
    """Edges are the values at the ranks; over many values each task sends a bounded number of points."""
    rows = spark.range(0, 90_000, 1, 3).select(F.lit("a").alias("g"), (F.col("id") * 7919 % 90_000).cast("double").alias("x"), F.when(F.col("id") % 2 == 0, F.col("id") % 10).cast("double").alias("y"), F.lit(None).cast("double").alias("z"))
    few = trees.edges_by(rows.where("x < 1000"), "g", ["x", "y", "z"], 4)["a"]
    assert [e.tolist() for e in few] == [[249.0, 499.0, 749.0], few[1].tolist(), []] and set(few[1]) <= {0.0, 2.0, 4.0, 6.0, 8.0}
    before = shuffled(spark)
    many = trees.edges_by(rows, "g", ["x"], 4)["a"][0]
    assert shuffled(spark) - before < 700_000 and np.abs(many - [22499, 44999, 67499]).max() <= 18


def test_fewer_children_give_the_others():
    """Sums of one child of each node and of the node give both."""
    draw = np.random.default_rng(3)
    at, x, w = draw.integers(0, 4, 500), draw.integers(0, 5, (2, 500)).astype(np.uint8), (draw.normal(size=500), draw.random(500))
    every, above = trees._histograms(at, x, w, 4, 5), trees._histograms(at >> 1, x, w, 2, 5)
    side = np.array([1, 0], np.uint8)
    use = np.flatnonzero(side[at >> 1] == (at & 1))
    own = trees._histograms(at[use] >> 1, x[:, use], tuple(v[use] for v in w), 2, 5)
    assert np.allclose(trees._children(above, own, side), every)


def test_names_of_lines_are_read_once_each(spark, monkeypatch):
    """Lines look their names up, are priced in one pass, and get what they get where there are too many names to be broadcast."""
    t = Tables(spark, "/root/testdata/sf0.001")
    found = pricing_queries.q_line_values(t)
    plan = planned(found)
    assert plan.count("_line_prices(") == 1 and "descanso" not in plan
    want = sorted(map(tuple, found.collect()))
    names = ("market", "label", "participant", "home_name", "away_name")
    lines = spark.createDataFrame([(None, "Más de", None, None, "x"), ("Total de goles - 1ª parte", None, "", "Ñu", "x")], ", ".join(f"{c} string" for c in names))
    lines = lines.withColumn("line", F.lit(2.5))
    assert sorted(map(str, pricing.requested(lines, pricing.names_of(lines)).collect())) == sorted(map(str, pricing.requested(lines).collect()))
    monkeypatch.setattr(pricing, "BROADCAST_NAMES", 3)
    assert pricing.names_of(lines) is None and sorted(map(tuple, pricing_queries.q_line_values(t).collect())) == want


def _legs(spark, rows):
    """Legs on the result (event_id, ticket_id, selection, odds)."""
    kind = "event_id long, ticket_id long, market string, selection string, line double, period string, side string, odds double"
    return spark.createDataFrame([(e, t, "Resultado Final", s, None, "completo", None, odds) for e, t, s, odds in rows], kind)


#: Home, draw, and an event that comes twice.
_SCORES = "event_id long, home_goals int, away_goals int, home_goals_ht int, away_goals_ht int"
_ODD_SCORES = [(1, 2, 0, 1, 0), (2, 1, 1, 0, 0), (3, 0, 1, 0, 0), (3, 0, 1, 0, 0), (None, 1, 0, 0, 0)]


def test_payouts_go_to_their_tickets_as_plain_rows(spark):
    """Tasks send no lists of the legs that they hold; tickets without an id or with repeated legs, and events without an id or with two scores, count as before."""
    legs = _legs(spark, [(2, 10, "X", 3.0), (1, 10, "1", 1.7), (1, 11, "1", 2.0), (9, 11, "1", 2.0), (None, 12, "1", 2.0), (1, None, "1", 1.5), (2, None, "1", 2.0), (3, 13, "2", 1.1), (1, 14, "1", 2.0), (1, 14, "1", 2.0)])
    made = settlement.settle_tickets(legs, spark.createDataFrame(_ODD_SCORES, _SCORES))
    plan = planned(made)
    assert "collect_list" not in plan and "HashAggregate" not in plan
    got = sorted((r.ticket_id or 0, r.n_legs, r.payout, r.paid) for r in made.collect())
    assert got == [(0, 2, 0.0, False), (10, 2, 1.7 * 3.0, True), (13, 2, 1.1 * 1.1, True), (14, 2, 4.0, True)]
    assert settlement.settle_tickets(legs.limit(0), spark.createDataFrame(_ODD_SCORES, _SCORES)).count() == 0


def test_terms_of_legs_travel_as_columns(spark):
    """No struct reaches the join with scores; legs that are null, or of no known market, period or side, stay open."""
    of = "struct<event_id:bigint,market:string,selection:string,line:double,period:string,side:string,odds:double>"
    leg = lambda m="Resultado Final", s="1", line=None, period="completo", side=None, e=1: (e, m, s, line, period, side, 2.0)
    every = [leg(), leg(None), leg(s=None), leg(period="x"), leg(period=None), leg("Hándicap asiático", "1", 0.25, "completo", "x"), leg("Total de goles", "Más de", None), leg("Resultado Correcto", "2-0"), None]
    legs = settlement.read_legs(spark.createDataFrame([(k, [x]) for k, x in enumerate(every)], f"k int, legs array<{of}>").selectExpr("k", "inline_outer(legs)"))
    made = settlement.settle_legs(legs, spark.createDataFrame(_ODD_SCORES, _SCORES))
    joined, _, dealt = planned(made).partition("Join")
    assert f"{settlement.TERMS}#" not in joined and f"{settlement.TERMS}#" not in dealt.split("\n")[0] and settlement.TERMS not in made.columns
    assert {r.k: r.payout for r in made.collect()} == {0: 2.0, 1: None, 2: 0.0, 3: None, 4: 2.0, 5: None, 6: None, 7: 2.0, 8: None}


def test_days_of_a_team_are_sorted_once_for_all_names(spark):
    """One window looks back over days without values of a name; teams and kickoffs that are null, repeated rows and an empty log count as in a loop over a team's rows."""
    draw, start = np.random.default_rng(8), datetime.datetime(2024, 1, 1)
    rows = []
    for k in range(300):
        played, shots = draw.random() > 0.3 and not 90 < k < 240, draw.random() > 0.6
        rows.append((k, "A", None if k % 50 == 3 else start + datetime.timedelta(hours=7 * k), None if k % 7 == 2 else f"t{k % 3}", k % 2, k % 5 if played else None, k % 4 if shots else None))
    rows += [rows[10], rows[280]]
    log = spark.createDataFrame(rows, "match_id long, league string, kickoff timestamp, team string, at_home int, gf int, sf int")
    log = log.withColumns({"ga": F.col("gf"), "pts": F.col("gf"), "sa": F.col("sf"), "xgf": F.col("sf") * 0.5, "xga": F.col("sf") * 0.5, "played_at": F.when(F.col("gf").isNotNull(), F.col("kickoff"))})
    made = features.team_features(log)
    assert planned(made).count("- Window [") == 1 and planned(made).count("Exchange hashpartitioning(team#") == 3
    mean = lambda x, n: round(sum(x[-n:]) / len(x[-n:]), 9) if x else None
    want = []
    for team in {r[3] for r in rows}:
        own = sorted((r for r in rows if r[3] == team), key=lambda r: (r[2] is not None, r[2] or start, r[0]))
        for k, r in enumerate(own):
            goals, shots = ([x[i] for x in own[:k] if x[i] is not None] for i in (5, 6))
            want.append((r[0], len(goals), mean(goals, 5), mean(goals, 10), mean(shots, 5)))
    got = [(r.match_id, r.prior, *(None if x is None else round(x, 9) for x in (r.gf_5, r.gf_10, r.sf_5))) for r in made.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and features.team_features(log.limit(0)).count() == 0
