"""Operators on literal cases: settlement truth table, lines, names, URLs, feed documents, pages, folds, tickets."""

import json
import math

import pytest
from pyspark.sql import functions as F

from touchline.functions import odds, text
from touchline.operators import crawl, diagnosis, elo, entity, facts, features, feed, folds, market, matches, metrics, pages, pricing, scorers, settlement, tickets


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


# ---- settlement, score 2-1 (half time 1-0)

LEGS = [
    ("Resultado Final", "1", None, "completo", None, (1, 0)), ("Resultado Final", "X", None, "completo", None, (0, 0)), ("Resultado Final", "2", None, "segunda", None, (0, 0)), ("Resultado Final", "X", None, "segunda", None, (1, 0)),
    ("Doble Oportunidad", "1X", None, "completo", None, (1, 0)), ("Doble Oportunidad", "X2", None, "completo", None, (0, 0)), ("Apuesta sin empate", "1", None, "completo", None, (1, 0)), ("Apuesta sin empate", "2", None, "completo", None, (0, 0)),
    ("Ambos Equipos Marcarán", "Sí", None, "completo", None, (1, 0)), ("Ambos Equipos Marcarán", "Sí", None, "primera", None, (0, 0)), ("Resultado Correcto", "2 - 1", None, "completo", None, (1, 0)), ("Resultado Correcto", "1-0", None, "primera", None, (1, 0)),
    ("Total de goles", "Más de", 2.5, "completo", None, (1, 0)), ("Total de goles", "Más de", 2.75, "completo", None, (0.5, 0.5)), ("Total de goles", "Más de", 3.25, "completo", None, (0, 0.5)), ("Total de goles", "Más de", 3.0, "completo", None, (0, 1)),
    ("Total de goles", "Menos de", 3.25, "completo", None, (0.5, 0.5)), ("Total de goles de Real", "Más de", 1.5, "completo", "local", (1, 0)), ("Total de goles de Real", "Más de", 1.5, "completo", None, None),
    ("Hándicap asiático", "1", -0.75, "completo", "local", (0.5, 0.5)), ("Hándicap asiático", "1", -1.25, "completo", "local", (0, 0.5)), ("Hándicap asiático", "2", 1.0, "completo", "visitante", (0, 1)), ("Hándicap asiático", "2", 1.5, "completo", "visitante", (1, 0)),
    ("Hándicap asiático", "1", -0.5, "completo", None, None), ("Hándicap 3-Way", "X", -1.0, "completo", None, (1, 0)), ("Hándicap 3-Way", "1", -1.0, "completo", None, (0, 0)), ("Total de Tiros de Esquina", "Más de", 9.5, "completo", None, None), ("Tarjetas", "x", None, "completo", None, None),
]


def leg_rows(spark, legs=LEGS, event=1):
    return spark.createDataFrame([(event, k, *x[:5], 2.0) for k, x in enumerate(legs)], "event_id long, k int, market string, selection string, line double, period string, side string, odds double")


def scores(spark, rows=((1, 2, 1, 1, 0),)):
    return spark.createDataFrame(list(rows), "event_id long, home_goals int, away_goals int, home_goals_ht int, away_goals_ht int")


def test_settlement_truth_table(spark):
    got = {x.k: x for x in settlement.settle_legs(leg_rows(spark), scores(spark)).collect()}
    for k, leg in enumerate(LEGS):
        want = leg[5]
        assert (None if got[k].won is None else (got[k].won, got[k].returned)) == want, leg
        assert got[k].payout == (None if want is None else want[0] * 2 + want[1])


def test_settlement_without_half_time(spark):
    got = settlement.settle_legs(leg_rows(spark), scores(spark, [(1, 2, 1, None, None)])).where("period <> 'completo'").select("won").collect()
    assert all(x.won is None for x in got)


def test_tickets_settle_whole(spark):
    legs = leg_rows(spark, LEGS[:2]).union(leg_rows(spark, LEGS[12:14], 2)).withColumn("ticket_id", F.col("event_id"))
    assert {x.ticket_id for x in settlement.settle_tickets(legs, scores(spark)).collect()} == {1}
    done = {x.ticket_id: x for x in settlement.settle_tickets(legs, scores(spark, [(1, 2, 1, 1, 0), (2, 2, 1, 1, 0)])).collect()}
    assert done[2].payout == 2 * 1.5 and done[2].paid and done[1].payout == 0


# ---- lines and prices


@pytest.mark.parametrize(("line", "parts"), [(-0.25, [-0.5, 0.0]), (0.75, [0.5, 1.0]), (-0.5, [-0.5]), (0.0, [0.0]), (-1.0, [-1.0]), (2.25, [2.0, 2.5])])
def test_halves(spark, line, parts):
    assert one(spark, odds.halves(F.lit(line))) == parts == pricing._parts(line)


def test_milli_units(spark):
    assert [one(spark, odds.milli_odds(F.lit(x))) for x in ("2380", "1000", None, "x")] == [2.38, None, None, None]
    assert one(spark, odds.milli_line(F.lit(2500))) == 2.5
    assert one(spark, odds.number(F.lit(float("nan")))) is None and one(spark, odds.whole(F.lit("3.9"))) == 3


def test_overround(spark):
    assert one(spark, odds.overround(F.lit(2.0), F.lit(3.5), F.lit(4.0))) > 1
    assert abs(one(spark, odds.overround(F.lit(3.0), F.lit(3.0), F.lit(3.0))) - 1) < 1e-12
    assert one(spark, odds.overround(F.lit(3.0), F.lit(None).cast("double"), F.lit(0.5))) is None


def test_prices_are_probabilities(spark):
    rates = spark.createDataFrame([(1, 1.5, 1.1), (2, 2.2, 0.62), (3, 0.95, 0.28)], "match_id long, lam double, mu double")
    grid = pricing.score_grid(rates, -0.1)
    assert all(abs(x.s - 1) < 1e-12 and x.lo >= 0 and x.n == 100 for x in grid.groupBy("match_id").agg(F.sum("p").alias("s"), F.min("p").alias("lo"), F.count("p").alias("n")).collect())
    c = pricing.Catalogue()
    rows = pricing.price(grid, c.everything() + c.asian_total(2.25) + c.asian_handicap(-0.75)).collect()
    by = {(x.match_id, x.market, x.selection, x.line): x for x in rows}
    for x in rows:
        assert abs(x.win + x.push + x.lose - 1) < 1e-9 and min(x.win, x.push, x.lose) >= -1e-12
    for m in (1, 2, 3):
        assert abs(sum(by[m, "Resultado Final", s, None].win for s in "1X2") - 1) < 1e-9
        assert abs(by[m, "Handicap asiatico", "1", -0.5].win - by[m, "Resultado Final", "1", None].win) < 1e-12
        assert by[m, "Handicap asiatico", "1", 0.0].push == pytest.approx(by[m, "Resultado Final", "X", None].win)
        over = [by[m, "Total de goles", "Mas de", x].win for x in pricing.TOTALS]
        assert over == sorted(over, reverse=True)
    # value of a fair bet is 0
    x = by[1, "Apuesta sin empate", "1", None]
    assert x.win * (x.fair_odds - 1) - x.lose == pytest.approx(0)


def test_poisson_and_tau(spark):
    for k in (0, 1, 7, 30):
        assert one(spark, odds.poisson(F.lit(k), F.lit(9.5))) == pytest.approx(math.exp(-9.5 + k * math.log(9.5) - math.lgamma(k + 1)))
    assert one(spark, odds.tau(F.lit(2), F.lit(0), F.lit(1.2), F.lit(1.1), F.lit(-0.1))) == 1.0
    assert one(spark, odds.tau(F.lit(1), F.lit(1), F.lit(1.2), F.lit(1.1), F.lit(-0.1))) == pytest.approx(1.1)


@pytest.mark.parametrize(
    ("market_name", "period"),
    [("Total de goles - 1.ª parte", "primera"), ("Total de goles - 1ª parte", "primera"), ("Total de goles 2ª parte", "segunda"), ("Primer tiempo", "primera"), ("Resultado Final", "completo"), ("Descanso", "primera")],
)
def test_period(spark, market_name, period):
    assert one(spark, text.market_period(text.market_normal(F.lit(market_name)))) == period


def test_requests(spark):
    rows = [
        ("Total de goles de Real Madrid - 1ª parte", "Más de", None, 0.5, ("Total de goles (local)", "Mas de", 0.5, "primera", "local")),
        ("Hándicap asiático", "x", "Sevilla", 0.75, ("Handicap asiatico", "2", -0.75, "completo", "visitante")), ("Hándicap asiático", "x", "Real Madrid", -0.75, ("Handicap asiatico", "1", -0.75, "completo", "local")),
        ("Total de goles de Otro", "Más de", None, 1.5, (None, "Mas de", 1.5, "completo", None)), ("Total de Tiros de Esquina", "Menos de", None, 9.5, ("Total de Tiros de Esquina", "Menos de", 9.5, "completo", None)),
        ("Hándicap de Tiros de Esquina", "x", None, 1.5, (None, None, None, None, None)), ("Doble Oportunidad", "1 o X", None, None, ("Doble Oportunidad", "1X", None, "completo", None)),
    ]
    df = spark.createDataFrame([(k, *r[:4], "Real Madrid", "Sevilla") for k, r in enumerate(rows)], "k int, market string, label string, participant string, line double, home_name string, away_name string")
    got = {x.k: x for x in df.withColumns(pricing.line_request()).collect()}
    for k, (*_, want) in enumerate(rows):
        x = got[k]
        assert x.want_market == want[0]
        if want[0]:
            assert (x.want_selection, x.want_line, x.period, x.side) == want[1:]


def test_priced_away_handicap_settles_in_its_own_perspective(spark):
    """The away side's +0.75 wins on a draw, in pricing and in settlement."""
    lines = spark.createDataFrame([(1, 1, "Hándicap asiático", "Sevilla", "Sevilla", 0.75, "Real Madrid", "Sevilla", 2.0)], "match_id long, event_id long, market string, label string, participant string, line double, home_name string, away_name string, odds double")
    grid = spark.createDataFrame([(1, 1, 1, 1.0)], "match_id long, h int, a int, p double")
    priced = pricing.price(grid, pricing.Catalogue().asian_handicap(-0.75)).withColumn("period", F.lit("completo"))
    leg = pricing.value_lines(lines, priced).withColumn("selection", F.col("want_selection"))
    assert leg.first().win == 1.0
    assert settlement.settle_legs(leg, scores(spark, [(1, 1, 1, 0, 0)])).first().won == 1.0


# ---- names


def test_slugs(spark):
    same = [("Man United", "Manchester United"), ("Atlético Madrid", "Atletico Madrid"), ("FC Köln", "Koln"), ("Brighton & Hove Albion", "Brighton")]
    for a, b in same:
        assert one(spark, text.team_slug(F.lit(a))) == one(spark, text.team_slug(F.lit(b)))
    assert one(spark, text.team_slug(F.lit("Manchester United"))) != one(spark, text.team_slug(F.lit("Manchester City")))
    assert one(spark, text.team_slug(F.lit(""))) == one(spark, text.team_slug(F.lit(None).cast("string"))) == ""
    assert one(spark, text.match_key(F.lit("E0"), F.lit("2024-08-10T15:00:00Z"), F.lit("Man United"), F.lit("Leeds"))) == one(spark, text.match_key(F.lit("E0"), F.lit("2024-08-10T20:00:00Z"), F.lit("Manchester United"), F.lit("Leeds United")))


def test_resolution_rules(spark):
    slugs = spark.createDataFrame([(x,) for x in ("stuttgart", "blackburn", "tottenham_hotspur", "manchester_united", "manchester_city", "real_sociedad", "real_betis", "borussia_monchengladbach", "wolverhampton_wanderers")], "slug string")
    names = ["Stuttgart", "VfB Stuttgart", "Blackburn Rovers", "Tottenham", "Manchester", "Real", "Borusia Mönchengladbach", "Nobody", "Bayern"]
    got = {x.name: x for x in entity.resolve(spark.createDataFrame([(n,) for n in names], "name string"), slugs).collect()}
    assert (got["Stuttgart"].slug, got["Stuttgart"].method) == ("stuttgart", "exacto")
    assert (got["VfB Stuttgart"].slug, got["VfB Stuttgart"].method, got["VfB Stuttgart"].confidence) == ("stuttgart", "nucleo", 0.97)
    assert (got["Blackburn Rovers"].slug, got["Tottenham"].slug) == ("blackburn", "tottenham_hotspur")
    assert got["Manchester"].slug is None and got["Manchester"].method == "subconjunto_ambiguo:2" and got["Real"].slug is None
    assert (got["Borusia Mönchengladbach"].slug, got["Borusia Mönchengladbach"].method) == ("borussia_monchengladbach", "similitud")
    assert got["Nobody"].slug is None and got["Nobody"].method == "sin_coincidencia"
    assert {x.method: x.n for x in entity.report(entity.resolve(spark.createDataFrame([(n,) for n in names], "name string"), slugs)).collect()}["exacto"] == 1


# ---- URLs and facts


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("HTTP://WWW.Marca.com:80/futbol/?b=2&a=1&utm_source=x#top", "https://marca.com/futbol?a=1&b=2"), ("https://as.com", "https://as.com/"), ("https://as.com/x//?q=", "https://as.com/x"),
        ("https://as.com/?q=a+b%20c&UTM_x=1&CMP=2&ref=3&z=%C3%A9*~", "https://as.com/?q=a+b+c&z=%C3%A9%2A~"), (" https://m.as.com:443/a/b ", "https://m.as.com/a/b"), ("ftp://x.com/a", "ftp://x.com/a"),
    ],
)
def test_url_normal(spark, raw, want):
    assert one(spark, text.url_normal(F.lit(raw))) == want


def test_url_classes(spark):
    get = lambda u: tuple(one(spark, text.url_class(F.lit(u))))
    assert get("https://x.com/noticias/la-liga/1") == ("noticias", "portada_general:laliga") and get("https://x.com/xg/1") == ("estadisticas_avanzadas", "xg_metricas") and get("https://x.com/q") == ("noticias", "sin_clasificar")
    assert not one(spark, text.url_on_topic(F.lit("https://x.com/futbol/f1/1"))) and one(spark, text.url_on_topic(F.lit("https://x.com/Futbol/1")))


def test_facts_gate(spark):
    good = ("https://a.com", "2024-01-01T00:00:00Z", "s", "t", "{}")
    rows = [good, ("", *good[1:]), ("ftp://a", *good[1:]), (good[0], "2024", *good[2:]), (good[0], good[1], None, *good[3:])]
    df = spark.createDataFrame(rows, "source_url string, extracted_at string, raw_snippet string, fact_type string, content string")
    assert {x.reason: x.n for x in facts.rejections(df).collect()} == {"missing:source_url": 1, "bad:source_url": 1, "bad:extracted_at": 1, "missing:raw_snippet": 1}
    assert facts.provenance(df).first().rate == 0.2 and facts.provenance(df.limit(0)).first().rate == 1.0


def test_crawl(spark):
    seeds = spark.createDataFrame([("marca.com", "es", "europa", "noticias")], "domain string, language string, region string, default_category string")
    got = crawl.records(spark.createDataFrame([("http://www.marca.com/futbol/x",), ("http://marca.com/tenis/futbol",)], "url string"), seeds).collect()
    assert len(got) == 1 and got[0].language == "es" and got[0].domain == "marca.com"
    robots = spark.createDataFrame([("a.com", "User-agent: *\nSitemap: https://a.com/i.xml")], "domain string, text string")
    landed = spark.createDataFrame([("https://a.com/i.xml", "<sitemapindex><loc>https://a.com/1.xml</loc></sitemapindex>"), ("https://a.com/1.xml", "<urlset><loc> https://a.com/p?a=1&amp;b=2 </loc><loc>https://a.com/q</loc></urlset>")], "url string, xml string")
    assert {x.url for x in crawl.expand_sitemaps(crawl.sitemap_links(robots), landed).collect()} == {"https://a.com/p?a=1&b=2", "https://a.com/q"}
    assert one(spark, crawl.feed_links(F.lit("<rss><item><link>https://a/1</link></item><item><link><![CDATA[https://a/2]]></link></item></rss>"))) == ["https://a/1", "https://a/2"]
    assert crawl.cap_for(1000, 55) == 50 and crawl.cap_for(10_000, 55) == 364


def test_pages(spark):
    html = '<html><head><title> T </title><script>var d = JSON.parse(\'{\\x22a\\x22: 1}\');</script></head><body><nav>no</nav><article><h1>Head</h1><p>One  two<br>three</p></article><!-- <table id="t1"><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr><tr><td></td><td></td></tr></table> --></body></html>'
    df = spark.createDataFrame([("u", html), ("v", None), ("w", "<table><tr><td>only</td></tr></table>")], "url string, html string")
    got = {x.url: x for x in df.select("url", pages.text_of("html").alias("t"), pages.datasets_of("html").alias("d")).collect()}
    assert got["u"].t.title == "T" and got["u"].t.text == "Head\nOne two\nthree" and got["u"].d == {"d": '{"a": 1}'} and got["v"].t.text is None
    rows = pages.table_rows(df).collect()
    assert [(x.url, x.table, x.n_cols, json.loads(x.cells)) for x in rows] == [("u", "t1", 2, {"a": "1", "b": "2"})]
    assert one(spark, facts.client_rendered(F.lit("<div id=app></div>"))) and not one(spark, facts.client_rendered(F.lit("<P class=x>")))


# ---- feed


def test_feed(spark, tmp_path):
    outcome = lambda i, **x: {"id": i, "label": "1", "odds": 2380, "status": "OPEN", **x}
    group = {"outcomes": [{"id": 3}], "groups": [{"outcomes": [{"id": 1}, {"id": 2}]}]}
    doc = {
        "event_id": 7, "league": "L",
        "betOffers": [{"id": 70, "criterion": {"id": 1, "label": "Resultado Final"}, "betOfferType": {"name": "Match"}, "outcomes": [outcome(1, participant="Real"), outcome(2, odds=1000), outcome(3, odds=None)]}, {"id": 71, "criterion": {"id": 2, "label": "Goleador"}, "outcomes": [outcome(4, eventParticipantId=9, line=2500)]}],
        "prePacks": [{"id": 5, "tags": ["a", "b"], "prePackSelections": [{"selectionId": 6, "label": ["x"], "status": "OPEN", "combinations": [{"odds": {"decimal": 5500}, "groups": [group]}, {"odds": {"decimal": 900}, "groups": [group]}, {"odds": {"decimal": 3000}, "groups": []}]}]}],
    }
    (tmp_path / "r.json").write_text(json.dumps(doc))
    responses = spark.read.schema(feed.RESPONSE).json(str(tmp_path / "r.json"))
    at = F.lit("2024-05-01T10:00:00Z")
    prices = {x.outcome_id: x for x in feed.prices(responses, at).collect()}
    assert set(prices) == {1, 4} and prices[1].odds == 2.38 and not prices[1].is_player and prices[4].is_player and prices[4].line == 2.5 and prices[1].capture_day == "2024-05-01"
    (pack,) = feed.packs(responses, at).collect()
    assert pack.legs == "3,1,2" and pack.n_legs == 3 and pack.odds == 5.5 and pack.tags == "a,b" and len(pack.pack_hash) == 16
    path = [{"englishName": "Football", "termKey": "football", "name": "Fútbol"}, {"name": "Jordania"}, {"name": "Premier", "termKey": "premier_league"}]
    (tmp_path / "e.json").write_text(json.dumps({"id": 1, "name": "A - B", "start": "2024-05-02T10:00:00Z", "path": path}))
    from touchline.sources.readers import feed_events

    (e,) = feed_events(spark, str(tmp_path / "e.json"), "2024-05-01T10:00:00Z").collect()
    assert (e.sport, e.country, e.league, e.league_key, e.home_name, e.away_name) == ("Football", "Jordania", "Premier", "premier_league", "A", "B")


# ---- features, folds, ratings


def league(spark, rounds=12, teams=8, poison=None):
    import random

    r, rows, k = random.Random(7), [], 0
    for day in range(rounds):
        order = list(range(teams))
        r.shuffle(order)
        for i in range(0, teams, 2):
            rows.append((f"m{k:04d}", "A", "2023", f"2023-01-{1 + 2 * day:02d} 15:00:00", order[i], order[i + 1], r.randrange(4), r.randrange(3), r.randrange(9), r.randrange(8)))
            k += 1
    if poison:
        rows.append(poison)
    return spark.createDataFrame(rows, "match_id string, league string, season string, kickoff string, home int, away int, home_goals int, away_goals int, home_shots int, away_shots int").withColumn("kickoff", F.to_timestamp("kickoff")), rows


def by_match(df):
    return {x.match_id: x.asDict() for x in df.collect()}


def test_features_do_not_leak(spark):
    all_matches, rows = league(spark)
    full = by_match(features.match_features(all_matches).join(elo.ratings(all_matches), "match_id"))
    cut = rows[: len(rows) // 2]
    half = all_matches.where(F.col("match_id") <= cut[-1][0])
    part = by_match(features.match_features(half).join(elo.ratings(half), "match_id"))
    assert all(full[m] == x for m, x in part.items()) and len(part) == len(cut)
    shuffled = all_matches.orderBy(F.rand(3)).repartition(7)
    assert by_match(features.match_features(shuffled)) == by_match(features.match_features(all_matches))
    poisoned, _ = league(spark, poison=("zzz", "A", "2030", "2030-01-01 15:00:00", 0, 1, 99, 0, 50, 0))
    after = by_match(features.match_features(poisoned).join(elo.ratings(poisoned), "match_id"))
    assert all(after[m] == x for m, x in full.items())


def test_ratings(spark):
    df, rows = league(spark)
    got, ratings = by_match(elo.ratings(df)), {}
    for m in rows:
        h, a = ratings.get(m[4], 1500.0), ratings.get(m[5], 1500.0)
        expect = 1 / (1 + 10 ** (-(h + 60 - a) / 400))
        assert got[m[0]]["home_elo"] == pytest.approx(h) and got[m[0]]["home_expectation"] == pytest.approx(expect)
        move = 20 * (1 + math.log1p(abs(m[6] - m[7]))) * ((m[6] > m[7]) + 0.5 * (m[6] == m[7]) - expect)
        ratings[m[4]], ratings[m[5]] = h + move, a - move
    assert sum(ratings.values()) == pytest.approx(1500 * len(ratings))


def test_unplayed_matches_take_no_place(spark):
    df, _ = league(spark)
    gap = df.unionByName(spark.createDataFrame([("x", "A", "2023", "2023-01-06 15:00:00", 0, 1, None, None, None, None)], "match_id string, league string, season string, kickoff string, home int, away int, home_goals int, away_goals int, home_shots int, away_shots int").withColumn("kickoff", F.to_timestamp("kickoff")))
    without, with_gap = by_match(features.match_features(df)), by_match(features.match_features(gap))
    assert all(with_gap[m] == x for m, x in without.items()) and with_gap["x"]["home_prior"] > 0


def test_fold_violations(spark):
    rows = [(1, "train", 5, 100), (1, "val", 3, 101), (1, "test", 4, 102), (1, "test", 9, 100), (2, "train", 1, 1), (2, "val", 2, 2), (2, "test", 3, 3)]
    got = {x.fold: x for x in folds.violations(spark.createDataFrame([(f, s, m, k) for f, s, k, m in rows], "fold int, split string, match_id int, kickoff int")).collect()}
    assert (got[1].train_after_val, got[1].train_in_test, got[1].shared) == (True, True, 1) and not any((got[2].train_after_val, got[2].val_in_test, got[2].train_in_test, got[2].shared))


def test_postponed_match_is_placed_by_kickoff(spark):
    rows = [(s * 1000 + i, str(s), s * 1000 + i) for s in range(2000, 2006) for i in range(300)] + [(999999, "2000", 2005 * 1000 + 50)]
    df = spark.createDataFrame(rows, "match_id long, season string, kickoff long")
    f = folds.season_folds(df)
    assert f.where("match_id = 999999 and split <> 'test' and fold = '2005'").count() == 0
    assert all(not any((x.train_after_val, x.val_in_test, x.train_in_test, x.shared)) for x in folds.violations(f).collect())


# ---- scores and bets


def test_brier_identities(spark):
    rows = [(1.0, 0.0, 0.0, 0), (1 / 3, 1 / 3, 1 / 3, 1), (1.0, 0.0, 0.0, 2)]
    for row, want in zip(rows, (0, 2 / 3, 2), strict=True):
        assert spark.createDataFrame([row], "p1 double, px double, p2 double, y int").agg(metrics.brier().alias("b")).first().b == pytest.approx(want)


def test_edges_of_bins(spark):
    df = spark.createDataFrame([(0.1, 1.0), (0.3, 0.0), (0.30000001, 1.0), (1.0, 1.0), (0.0, 0.0)], "p double, hit double")
    assert {x.bin: x.n for x in metrics.calibration_right(df, "p", "hit", least=1).collect()} == {0: 1, 2: 1, 3: 1}
    assert [one(spark, diagnosis.band(F.lit(x))) for x in (0.0, 0.1, 0.10001, 0.65, 1.0, 1.1)] == [None, 0, 1, 4, 5, None]
    assert diagnosis.two_sided(13) == pytest.approx(2.89, abs=0.01)


def test_lines_and_margins(spark):
    prices = spark.createDataFrame([(1, "m", 1, "t1", 2.0, False), (2, "m", 1, "t1", 1.9, False), (1, "m", 1, "t2", 2.1, False), (2, "m", 1, "t2", 1.8, True)], "outcome_id int, market string, offer_id int, captured_at string, odds double, is_player boolean")
    (x,) = market.offer_margins(prices, least=2).collect()
    assert x.n_offers == 2 and x.is_player
    moved = market.line_movement(prices).first()
    assert moved.captures == 2 and moved.outcomes == 2 and moved.volatile == 0
    assert market.latest_capture(prices).count() == 2


def test_scorers(spark):
    cols = "player string, goals int, played int"
    got = {x.player: x for x in scorers.shrunk_rates(spark.createDataFrame([("a", 3, 3), ("new", 1, 2)], cols), spark.createDataFrame([("a", 27, 36), ("gone", 10, 20), ("few", 2, 4)], cols)).collect()}
    assert got["a"].rate == pytest.approx((3 + 10 * 0.75) / 13) and got["a"].reliable and not got["new"].reliable and got["gone"].rate == 0.5 and got["gone"].stands_on == 10 and "few" not in got
    chances = scorers.scoring_chances(spark.createDataFrame([("a", 0.8, True), ("b", 0.8, False)], "player string, rate double, reliable boolean"), spark.createDataFrame([(1, "a", 1.35), (1, "b", 1.35)], "match_id int, player string, team_goals double")).collect()
    assert len(chances) == 1 and chances[0].p1 == pytest.approx(1 - math.exp(-0.8)) and chances[0].p1 > chances[0].p2 > chances[0].p3


def test_matches(spark):
    assert matches.inputs(["match_id", "home", "form", "y_total"]) == ["form"]
    df = spark.createDataFrame([(2, 1, 1, 2), (2, 1, None, None), (3, 0, 1, 0)], "home_goals int, away_goals int, home_goals_ht int, away_goals_ht int")
    assert matches.first_half(df).count() == 2 and [tuple(x)[:2] for x in matches.second_half(df).collect()] == [(2, 0)]
    assert matches.mean_corners(spark.createDataFrame([(5, 6)], "home_corners int, away_corners int")).first().mean_corners == 10.2


def test_greedy_tickets(spark):
    legs = spark.createDataFrame([("d", e, e * 10 + k, 1.5 + 0.5 * k, 0.1 / (e + k)) for e in range(1, 9) for k in range(3)], "day string, event_id long, outcome_id long, odds double, ev double")
    rows = tickets.greedy(legs, target=8.0, tickets=3).join(legs, ["day", "event_id", "outcome_id"]).collect()
    by = {}
    for x in rows:
        by.setdefault(x.ticket, []).append(x)
    assert by and len({x.outcome_id for x in rows}) == len(rows)
    for legs_of in by.values():
        assert len({x.event_id for x in legs_of}) == len(legs_of) >= 2 and 8 * 0.65 <= math.prod(x.odds for x in legs_of) <= 8 * 1.35


def test_ledger(spark):
    leg = "array<struct<event_id:bigint,market:string,selection:string,line:double,period:string,side:string,odds:double>>"
    a = [(1, "Resultado Final", "1", None, "completo", None, 2.0), (2, "Total de goles", "Más de", 2.5, "completo", None, 1.5)]
    issued = spark.createDataFrame([(a, 2.0, 0.1), (a[::-1], 2.0, 0.1)], f"legs {leg}, stake double, promised_ev double").withColumn("ticket_id", tickets.ticket_id(F.col("legs")))
    fresh = tickets.new_tickets(issued, issued.limit(0))
    assert fresh.count() == 1 and tickets.new_tickets(issued, fresh).count() == 0
    done = tickets.settle_ledger(fresh, scores(spark, [(1, 1, 0, 0, 0), (2, 2, 1, 1, 1)])).first()
    assert (done.state, done.payout, done.net) == ("liquidado", 3.0, 4.0)
    open_ = tickets.settle_ledger(fresh, scores(spark, [(1, 1, 0, 0, 0)]))
    assert open_.first().state == "pendiente" and tickets.ledger_summary(open_).first().settled == 0


@pytest.mark.parametrize(
    ("market_name", "selection", "line", "side", "want"),
    [("Hándicap asiático", "1", -1.5, None, "Real -1.5"), ("Hándicap asiático", "x", 0.75, "visitante", "Betis +0.75"), ("Total de goles", "Menos de", 1.5, None, "Menos de 1.5"), ("Resultado Final", "X", None, None, "Empate"), ("Resultado Final", "2", None, None, "Betis"), ("Total de goles", "Más de", 3.0, None, "Más de 3")],
)
def test_selection_labels(spark, market_name, selection, line, side, want):
    got = text.selection_label(F.lit("Real - Betis"), F.lit(market_name), F.lit(selection), F.lit(line).cast("double"), F.lit(side).cast("string"))
    assert one(spark, got) == want


def test_league_keys(spark):
    wanted = spark.createDataFrame([("Inglaterra", "premier_league")], "country string, league_key string")
    rows = spark.createDataFrame([("Inglaterra", "premier_league", 1), ("Jordania", "premier_league", 2)], "country string, league_key string, n int")
    assert [x.n for x in feed.selected_leagues(rows, wanted).collect()] == [1]
    assert feed.missing_leagues(rows.select("country", "league_key"), wanted.select("country", "league_key")).count() == 1


def test_closing_probabilities(spark):
    quotes = spark.createDataFrame([("m", "b", 1, 2.0, 4.0, 4.0), ("m", "b", 2, 4.0, 4.0, 2.0), ("n", "b", 1, 2.0, None, 4.0)], "match_id string, book string, kickoff int, odds_1 double, odds_x double, odds_2 double")
    got = {x.match_id: x for x in market.closing_probabilities(spark.createDataFrame([("m",), ("n",), ("o",)], "match_id string"), quotes, "b").collect()}
    assert (got["m"].p1, got["m"].p2) == (0.25, 0.5) and got["n"].p1 is None and got["o"].p1 is None
