"""URL filter: rules by host and path decide first, and a logistic regression over hashed character n-grams decides the rest.

DataFrame operations only: n-grams of host and path are hashed and weighed by Spark ML's transformers, within the JVM and within
the row, so a table of any size is one pass without a shuffle.  The regression is fitted on a small labelled table of URLs
(at most LABELLED rows, the first by a hash; the built-in one has under 200).

A rule is an action, a host and the start of a path; it fits its host and all subdomains.  Of the rules that fit, the one with the
longest text (host and path) decides, of equal ones the one with the longest host.  Rules are looked up by the suffixes of a URL's host, so their
number doesn't count.

Nulls: a null URL, or one without "://", has an empty host and path; no rule fits it, and it is scored by the bias alone.  A null page_id stays
null.  Very long URLs count whole.  Repeated rows give equal rows.  Empty tables give empty results.  Without labelled rows, or with labels of one kind
only, the model's verdict is that kind, or allow.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import bounded_sample

#: Lengths of n-grams, their hash buckets, the weight of the penalty, and labelled rows at most.
GRAMS, BUCKETS, RIDGE, LABELLED = (3, 4, 5), 1 << 16, 0.003, 20_000

# The rules of the contract.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

# A small table of hosts that are to be kept or dropped, the paths that either kind is seen with, and paths that tell.
KEPT_HOSTS = """www.rivertown-library.org news.harbourpost.com blog.thornton.net theatre.northern.org en.opencyclopedia.org
www.thistlegarden.net m.weatherstation.com docs.stringlib.io school.hillside.edu recipes.auntmartha.com
www.nationalpark.gov shop.bookbinder.com thetion.example.org blog.inger.example.net andther.example.org
m.thander.example.net www.stoner.example.org erstion.example.net ingtion.example.com forum.astronomers.org
www.citymuseum.org history.stanton.edu status.cloudhost.io podcast.sciencehour.fm help.accounting.com
www.trainline-info.net jobs.engineering.org lectures.mathdept.edu www.oceanresearch.org radio.eastcoast.net
photos.mountainclub.org translate.wordbook.net www.chesscircle.org farm.orchardvalley.com
gov.district.example.org code.opensource.example.net blog.winter.example.org www.pillar-architecture.com
track.athletics.example.org www.freeman.example.net better-gardens.example.org adult-education.example.org
www.cheapside-history.org casino-theatre-museum.example.org addison.example.net www.windmill.example.net
spamalot-musical.example.org m.orther.example.net enting.example.org hershall.example.com theform.example.net
www.ationes.example.org thandale.example.org ionther.example.net thering-estate.example.org
herence.example.net otherworld.example.org wither.example.net"""
DROPPED_HOSTS = """casino-royal.example.com www.online-casino.net blog.casinos-online.example.net m.mega-casino-bonus.com
win-jackpot.example.org big-win-slots.example.net casinowin24.com poker-win.example.org
free-bet-offer.example.net www.sports-bets.example.com freebets365.net best-free-betting.com
bets-live.example.org free-spins.example.net cheap-viagra.example.com www.pills-online.example.net
blog.cheap-meds.example.org diet-pills.example.com cheappills-store.net buy-cheap-drugs.example.net
pharma-pills-discount.org adult-video.example.com www.xxx-adult.net adult-xxx-chat.example.org
m.sexy-adult-dating.com hot-x-videos.example.net adultcams-x.com adult-x-tube.org spam-links.example.org
www.link-farm.example.net blog.spam-site.example.com seo-farm-links.com spamfarm-seo.net
content-farm-spam.example.org ads-server.example.com www.ad-track.net m.ads-click.example.org
track-ads.example.net banner-ads.example.com adstracker.net click-tracking-ads.org
popup-ads-tracks.example.net"""
PATHS = "/en/7120 /de/4411.html /fr/12/ /es/903 /it/55 /en/31/ /de/204 /fr/900.html /es/3/ /en/18.html /de/6031 /fr/77 / /index.html /en/catalogue /about"
KEPT_PATHS = "/wiki/glacier /archive/1848 /recipes/rye-bread /papers/2019/tides /albums/summer /exhibits/bronze /lectures/analysis /trails/map /timetable /library/opening-hours"
DROPPED_PATHS = "/buy-cheap-pills /casino/slots/777 /free-bets/bonus /adult/xxx-video /ads/click /spam/backlinks /viagra-discount /poker/jackpot /track/pixel /link-farm"


def parsed(url: str = "url") -> tuple[Column, Column]:
    """The host, A-Z in lower case, and the path of a URL; empty without "://"."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)


def ruling(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The rule (struct of action and rule, host and path as one text) that decides, or null."""
    if not rules:
        return F.lit(None).cast("struct<action:string,rule:string>")
    by_host: dict[str, list] = {}
    for action, h, p in rules:
        by_host.setdefault(h, []).append((action, p, h + p))
    entry = lambda h, found: F.struct(F.lit(h).alias("key"), F.array(*(F.struct(F.lit(a).alias("action"), F.lit(p).alias("start"), F.lit(r).alias("rule"), F.lit(len(h)).alias("size")) for a, p, r in found)).alias("value"))
    table = F.map_from_entries(F.array(*(entry(h, found) for h, found in by_host.items())))
    labels = F.split(host, r"\.")
    most = max(h.count(".") for h in by_host) + 1
    suffixes = [F.array_join(F.slice(labels, -k, k), ".") for k in range(1, most + 1)]
    fitting = [F.filter(F.coalesce(F.when(F.size(labels) >= k, F.try_element_at(table, s)), F.lit(None).cast("array<struct<action:string,start:string,rule:string,size:int>>"), F.array().cast("array<struct<action:string,start:string,rule:string,size:int>>")), lambda x: F.startswith(path, x["start"])) for k, s in enumerate(suffixes, 1)]
    ranked = F.array_max(F.transform(F.flatten(F.array(*fitting)), lambda x: F.struct(F.length(x["rule"]).alias("long"), x["size"].alias("size"), x["action"].alias("action"), x["rule"].alias("rule"))))
    return F.when(ranked.isNotNull(), F.struct(ranked["action"].alias("action"), ranked["rule"].alias("rule")))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The built-in table: url, and label (1: to block).  The k-th host of a kind is seen with the (3 k)-th path, so that both kinds have the same ones, and paths that tell stand at hosts that don't."""
    paths = PATHS.split()

    def kind(hosts: str, told: str, label: float) -> DataFrame:
        urls = [f"https://{h}{paths[3 * k % len(paths)]}" for k, h in enumerate(hosts.split())] + [f"https://site.example.{t}{p}" for p in told.split() for t in ("org", "net")]
        return spark.range(1).coalesce(1).select(F.explode(F.split(F.lit(" ".join(urls)), " ")).alias("url"), F.lit(label).alias("label"))

    return kind(KEPT_HOSTS, KEPT_PATHS, 0.0).unionByName(kind(DROPPED_HOSTS, DROPPED_PATHS, 1.0))


def _grams(rows: DataFrame) -> DataFrame:
    """Column __grams: the n-grams of the host, whose ends are marked, and those of the path; a run of digits counts as one digit."""
    host, path = parsed()
    letters = lambda c: F.filter(F.split(F.regexp_replace(c, "[0-9]+", "0"), ""), lambda x: x != "")
    rows = rows.withColumns({"__host": letters(F.when(host != "", F.concat(F.lit("^"), host, F.lit("$"))).otherwise("")), "__path": letters(path)})
    for part in ("__host", "__path"):
        for n in GRAMS:
            rows = NGram(n=n, inputCol=part, outputCol=f"{part}_{n}").transform(rows)
    of_path = F.transform(F.concat(*(f"__path_{n}" for n in GRAMS)), lambda x: F.concat(F.lit("/"), x))
    return rows.withColumn("__grams", F.concat(*(f"__host_{n}" for n in GRAMS), of_path))


def fit_urls(labelled: DataFrame) -> PipelineModel | float:
    """The fitted model over URLs (url, label: 1 to block), or without two kinds of labels the probability of the one there is."""
    rows = bounded_sample(labelled.where("url is not null and label is not null").select("url", F.col("label").cast("double").alias("label")), "url", LABELLED)
    share = rows.agg(F.avg("label")).first()[0]
    if share is None or share in (0.0, 1.0):
        return share or 0.0
    rows = _grams(rows).select("label", "__grams").coalesce(1)  # few rows: a step of the descent is one task
    hashed = HashingTF(numFeatures=BUCKETS, binary=True, inputCol="__grams", outputCol="__x")
    logit = LogisticRegression(regParam=RIDGE, maxIter=60, standardization=False, featuresCol="__x", labelCol="label", probabilityCol="__probability", rawPredictionCol="__raw", predictionCol="__predicted")
    return Pipeline(stages=[hashed, logit]).fit(rows)


def url_filter(pages: DataFrame, labelled: DataFrame | None = None, rules: tuple = RULES, cut: float = 0.5) -> DataFrame:
    """Per row of pages: page_id, host, path, rule (null if none fits), verdict (allow or block) and score, the model's probability that the URL is to be blocked."""
    model = fit_urls(labelled_urls(pages.sparkSession) if labelled is None else labelled)
    host, path = parsed()
    rows = _grams(pages.select("page_id", F.col("url")))
    scored = rows.withColumn("score", F.lit(model)) if isinstance(model, float) else model.transform(rows).withColumn("score", vector_to_array("__probability")[1])
    found = scored.select("page_id", host.alias("host"), path.alias("path"), "score").withColumn("__rule", ruling(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("__rule.action"), F.when(F.col("score") >= cut, "block").otherwise("allow"))
    return found.select("page_id", "host", "path", F.col("__rule.rule").alias("rule"), verdict.alias("verdict"), "score")
