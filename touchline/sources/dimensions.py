"""Small fixed dimensions, as DataFrames that joins may broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Domains that a crawl starts from, with language, region and default category.
SEEDS = (
    ("marca.com", "es", "europa", "noticias"),
    ("as.com", "es", "europa", "noticias"),
    ("mundodeportivo.com", "es", "europa", "noticias"),
    ("sport.es", "es", "europa", "noticias"),
    ("relevo.com", "es", "europa", "noticias"),
    ("estadiodeportivo.com", "es", "europa", "noticias"),
    ("lequipe.fr", "fr", "europa", "noticias"),
    ("gazzetta.it", "it", "europa", "noticias"),
    ("tuttosport.com", "it", "europa", "noticias"),
    ("corrieredellosport.it", "it", "europa", "noticias"),
    ("kicker.de", "de", "europa", "noticias"),
    ("bild.de", "de", "europa", "noticias"),
    ("record.pt", "pt", "europa", "noticias"),
    ("abola.pt", "pt", "europa", "noticias"),
    ("bbc.com", "en", "europa", "noticias"),
    ("skysports.com", "en", "europa", "noticias"),
    ("theguardian.com", "en", "europa", "noticias"),
    ("goal.com", "en", "global", "noticias"),
    ("espn.com", "en", "global", "noticias"),
    ("ole.com.ar", "es", "latam", "noticias"),
    ("tycsports.com", "es", "latam", "noticias"),
    ("lanacion.com.ar", "es", "latam", "noticias"),
    ("globoesporte.globo.com", "pt", "latam", "noticias"),
    ("lance.com.br", "pt", "latam", "noticias"),
    ("futbolred.com", "es", "latam", "noticias"),
    ("golcaracol.com", "es", "latam", "noticias"),
    ("antena2.com.co", "es", "latam", "noticias"),
    ("elcolombiano.com", "es", "latam", "noticias"),
    ("record.com.mx", "es", "latam", "noticias"),
    ("mediotiempo.com", "es", "latam", "noticias"),
    ("fbref.com", "es", "global", "estadisticas_avanzadas"),
    ("understat.com", "en", "global", "estadisticas_avanzadas"),
    ("whoscored.com", "en", "global", "estadisticas_avanzadas"),
    ("soccerway.com", "en", "global", "estadisticas_avanzadas"),
    ("footystats.org", "en", "global", "estadisticas_avanzadas"),
    ("worldfootball.net", "en", "global", "estadisticas_avanzadas"),
    ("forebet.com", "en", "global", "predicciones"),
    ("predictz.com", "en", "global", "predicciones"),
    ("clubelo.com", "en", "global", "predicciones"),
    ("oddsportal.com", "en", "global", "predicciones"),
    ("betexplorer.com", "en", "global", "predicciones"),
    ("windrawwin.com", "en", "global", "predicciones"),
    ("transfermarkt.es", "es", "global", "rumores_fichajes"),
    ("fichajes.com", "es", "global", "rumores_fichajes"),
    ("footballtransfers.com", "en", "global", "rumores_fichajes"),
    ("coachesvoice.com", "en", "global", "analisis_tactico"),
    ("spielverlagerung.com", "de", "europa", "analisis_tactico"),
    ("totalfootballanalysis.com", "en", "global", "analisis_tactico"),
    ("flashscore.com", "en", "global", "resultados_vivo"),
    ("sofascore.com", "en", "global", "resultados_vivo"),
    ("365scores.com", "en", "global", "resultados_vivo"),
    ("livescore.com", "en", "global", "resultados_vivo"),
    ("besoccer.com", "es", "global", "resultados_vivo"),
    ("reddit.com", "en", "global", "comunidades_foros"),
    ("bigsoccer.com", "en", "global", "comunidades_foros"),
)
# Leagues by code, with country and level.
LEAGUES = (
    ("E0", "Premier League", "Inglaterra", 1), ("E1", "Championship", "Inglaterra", 2), ("SP1", "LaLiga", "Espana", 1),
    ("SP2", "LaLiga 2", "Espana", 2), ("I1", "Serie A", "Italia", 1), ("D1", "Bundesliga", "Alemania", 1),
    ("F1", "Ligue 1", "Francia", 1), ("N1", "Eredivisie", "Paises Bajos", 1), ("P1", "Primeira Liga", "Portugal", 1),
)
# Leagues of the feed by country and key (a key alone isn't unique) and their code.
FEED_LEAGUES = (
    ("Inglaterra", "premier_league", "E0"), ("Inglaterra", "the_championship", "E1"), ("Espana", "la_liga", "SP1"),
    ("Italia", "serie_a", "I1"), ("Alemania", "bundesliga", "D1"), ("Francia", "ligue_1", "F1"),
    ("Paises Bajos", "eredivisie", "N1"), ("Portugal", "primeira_liga", "P1"),
)
# Leagues with a free source of scorers, and its number for them.
SCORER_LEAGUES = (
    ("Inglaterra", "premier_league", 2021), ("Inglaterra", "the_championship", 2016), ("Espana", "la_liga", 2014),
    ("Italia", "serie_a", 2019), ("Alemania", "bundesliga", 2002), ("Francia", "ligue_1", 2015),
    ("Paises Bajos", "eredivisie", 2003), ("Portugal", "primeira_liga", 2017), ("Brasil", "brasileirao_serie_a", 2013),
)
# Leagues captured unless others are asked for.
CAPTURED_LEAGUES = (
    ("Inglaterra", "premier_league"), ("Inglaterra", "the_championship"), ("Inglaterra", "league_one"), ("Inglaterra", "league_two"),
    ("Espana", "la_liga"), ("Espana", "la_liga_2"), ("Italia", "serie_a"), ("Italia", "serie_b"), ("Alemania", "bundesliga"), ("Francia", "ligue_1"),
    ("Paises Bajos", "eredivisie"), ("Portugal", "primeira_liga"), ("Brasil", "brasileirao_serie_a"), ("Brasil", "brasileirao_serie_b"),
    ("Argentina", "liga_profesional_argentina"), ("Argentina", "primera_nacional"), ("Mexico", "liga_mx"), ("Estados Unidos", "mls"),
    ("Belgica", "jupiler_pro_league"), ("Suecia", "allsvenskan"), ("Peru", "liga_1"), ("Paraguay", "primera_paraguay"),
)
# Competitions of results by the league's name.
RESULT_COMPETITIONS = (
    ("Premier League", 2021), ("Championship", 2016), ("La Liga", 2014), ("Serie A", 2019), ("Bundesliga", 2002), ("Ligue 1", 2015),
    ("Eredivisie", 2003), ("Primeira Liga", 2017), ("Brasileirao Serie A", 2013),
)


def captured_leagues(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CAPTURED_LEAGUES), "country string, league_key string")


def result_competitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RESULT_COMPETITIONS), "league string, competition int")


def seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SEEDS), "domain string, language string, region string, default_category string")


def leagues(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEAGUES), "league string, name string, country string, level int")


def feed_leagues(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FEED_LEAGUES), "country string, league_key string, league string")


def scorer_leagues(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SCORER_LEAGUES), "country string, league_key string, competition int")
