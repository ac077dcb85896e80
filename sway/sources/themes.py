"""High-level themes of the study's topics (a small fixed dimension table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Theme -> topic slugs, in the study's order.  A slug listed under several
# themes belongs to the last one (the study builds its lookup by overwriting); unmatched
# topics fall into "Other".
THEMES = {
    "Digital Life, Science, & Technology": [
        "pokemon-go", "artificial-intelligence-AI", "binge-watching", "cell-phones", "internet",
        "net-neutrality", "social-media", "space-colonization", "tiktok", "video-games", "tablets-vs-textbooks"],
    "Government & Civics": [
        "american-socialism", "congressional-term-limits", "dc-and-puerto-rico-statehood", "filibuster",
        "mandatory-national-service", "sanctuary-cities", "us-supreme-court", "american-civil-liberties-union-aclu",
        "us-pledge-of-allegiance"],
    "Education": [
        "animal-dissection", "book-bans", "cell-phones", "college-education", "corporal-punishment", "free-college",
        "homework", "school-uniforms", "school-vaccine-mandates", "standardized-tests", "student-loan-debt",
        "school-vouchers", "teacher-tenure"],
    "Health & Medicine": [
        "abortion", "birth-control", "maid-medical-aid-in-dying", "medical-marijuana", "milk", "obesity",
        "prescription-drug-costs", "universal-health-care", "vaping", "employer-vaccine-mandates", "obamacare"],
    "Environment & Animal Rights": [
        "alternative-energy", "animal-dissection", "animal-testing", "cannabidiol-cbd-for-pets", "fracking",
        "fur-clothing-bans", "gmos", "pit-bull-bans", "single-use-plastics", "vegetarianism", "zoos",
        "climate-change", "dakota-access-pipeline", "fur-clothing-bans", "gmos", "pit-bull-bans",
        "single-use-plastics", "vegetarianism", "zoos", "climate-change", "dakota-access-pipeline"],
    "Elections & Presidents": [
        "election-day", "electoral-college", "felon-voting", "voting-age", "voting-machines", "bill-clinton",
        "ronald-reagan"],
    "Society & Holidays": [
        "cancel-culture", "daylight-saving-time", "dress-codes", "historical-statue-removal", "homelessness",
        "reparations-for-slavery", "sanctuary-cities", "santa-claus", "saturday-halloween", "gay-marriage",
        "ride-sharing"],
    "Sports": [
        "cheerleading", "fighting-in-hockey", "football", "golf", "national-anthem-protest", "olympics",
        "sports-and-drugs", "college-football-playoffs", "paying-college-athletes"],
    "Law & Order": [
        "constitutional-carry-of-guns", "death-penalty", "defund-the-police", "drinking-age", "gun-control",
        "police-body-cameras", "private-prisons", "recreational-marijuana-legalization",
        "dare-drug-abuse-resistance-education", "prostitution"],
    "Economy & Taxes": [
        "corporate-tax-rate", "gig-economy", "gold-standard", "minimum-wage", "social-security",
        "universal-basic-income-ubi", "us-penny", "big-three-auto", "churches-and-taxes",
        "insider-trading-by-congress"],
    "Immigration & International Scene": [
        "cuba-embargo", "immigration", "sanctuary-cities", "drones", "us-drone-shot-down-by-iran", "us-iraq-war",
        "wtc-muslim-center"],
}


def theme_pairs() -> list[tuple[str, str]]:
    """(slug, theme) with the last listing winning, in first-seen slug order."""
    last: dict[str, str] = {}
    for theme, slugs in THEMES.items():
        for s in slugs:
            last[s] = theme
    return list(last.items())


def theme_table(spark: SparkSession) -> DataFrame:
    """The lookup as a two-column dimension (about a hundred rows; AQE broadcasts it)."""
    return spark.createDataFrame(theme_pairs(), "issue string, theme string")


def with_theme(df: DataFrame, themes: DataFrame, issue_col: str = "issue") -> DataFrame:
    t = themes.withColumnRenamed("issue", issue_col)
    return df.join(t, issue_col, "left").withColumn("theme", F.coalesce("theme", F.lit("Other")))
