"""A synthetic docket with known truth: form letters, letters with inserts, paraphrases, substantive letters and singletons."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.operators import campaigns, linkage, parsing

DOCKET = "SAMPLE-2031-0007"
LETTER = (
    "Please do not adopt the draft ferry noise standard. Our harbor towns depend on the early boats, and the hull changes it demands "
    "would end the winter timetable for years. Nothing in the draft shows that residents would hear any difference at night. "
    "I ask the board to drop the standard."
)
INSERTS = (
    "My mother takes the five o'clock boat to dialysis three times each week and there is no road around the inlet that an ambulance could use.",
    "I have piloted the Gull Island run since 1994 and measured the engine room myself last spring with a borrowed meter on two calm evenings.",
    "Our cannery ships forty crates before sunrise and losing that sailing would close the line and lay off every packer on the pier.",
)
_ASKS = ("Withdraw this measure.", "The board should abandon the plan.", "Kindly leave vessels as they are.", "Such a mandate must be refused.", "I oppose what you intend.")
_BURDENS = ("Ferry fares would climb beyond reach.", "Higher fares hurt ferry riders badly.", "Riders cannot afford dearer ferry fares.", "Costly fares would strand ferry commuters.", "Commuters already struggle with ferry fares.")
_EVIDENCE = ("Quieter nights remain unproven.", "Proof of quieter nights is absent.", "You offer no proof about quieter nights.", "Claims of quieter nights lack proof.", "Where is proof that nights become quieter?")
ANSWERED = (
    ("Harbor Operators League", "The league disputes the dry dock estimate. Invoices from nineteen yards put hull insulation near ninety thousand dollars per vessel while the economic appendix assumes thirty. We request that section 3.4(a) exempt vessels under twenty meters and that the appendix be recalculated with current yard invoices."),
    ("Shoreline Sleep Society", "Our audiologists recorded bedrooms along the eastern quay. Median peaks reached sixty one decibels after midnight. We urge monitoring stations and request that section 6.2 set a nightly decibel ceiling measured inside bedrooms rather than at the waterline."),
    ("Coastal Law Clinic", "The harbor statute delegates navigation safety only. No clause delegates acoustic design authority over private hulls, and the flexibility analysis for small entities is missing. The clinic therefore questions jurisdiction and statutory delegation for acoustic design."),
    ("Association of Island Councils", "Seven councils run ordinances on vessel sound already. The draft says nothing about preemption of island ordinances. Councils request explicit savings language for island ordinances and a uniform effective date across councils."),
)
UNANSWERED = (
    ("Marine Radio Guild", "Transponder firmware logs under section 12.1 must be mailed on magnetic tape. Guild technicians own no tape drives. Permit encrypted uploads of transponder firmware logs instead."),
    ("Dr. Ilse Brandt, oceanographer", "Porpoise strandings correlate with sonar calibration pulses. My buoy transects over eleven winters quantify strandings by pulse frequency. Consider seasonal sonar calibration limits near porpoise calving grounds."),
)
FINAL = """[[Page 71002]]
Discussion of comments

Comment: A league of operators disputed the dry dock estimate in the economic appendix and supplied yard invoices for hull insulation per vessel.

Response: The board recalculated the economic appendix with the yard invoices and exempted vessels under twenty meters in section 3.4(a) of the final text.

[[Page 71009]]
Comment: Sleep researchers and audiologists recorded bedrooms along the quay and asked for a nightly decibel ceiling measured inside bedrooms.

Response: The board added monitoring stations and a nightly decibel ceiling to section 6.2, measured inside bedrooms along the quay as requested.

Comment: A clinic questioned jurisdiction, arguing that the harbor statute delegates navigation safety and no acoustic design authority over private hulls.

Response: The board disagrees. The harbor statute delegates acoustic design authority with navigation safety, and the flexibility analysis for small entities was published.

[[Page 71015]]
Comment: Island councils asked about preemption of island ordinances and a uniform effective date across councils.

Response: The final text contains savings language that keeps island ordinances in force and a uniform effective date across councils.

Comment: Some writers described the history of lighthouse painting and offered archival photographs of keepers.

Response: The board thanks them for the archival photographs of lighthouse keepers, which it placed in the reading room of the archive.
"""


def rows(exact: int = 120, near: int = 90, seed: int = 7) -> list[tuple[str, str, str | None, str]]:
    """(comment_id, text, organization, truth)."""
    rng = random.Random(seed)
    texts: list[tuple[str, str | None, str]] = [(LETTER, None, "campaign_exact")] * exact
    texts += [(f"{LETTER} {INSERTS[i % 3]}", None, "campaign_near") for i in range(near)]
    texts += [(f"{_ASKS[i % 5]} {_BURDENS[i // 2 % 5]} {_EVIDENCE[i // 3 % 5]}", None, "campaign_paraphrase") for i in range(30)]
    texts += [(f"{_ASKS[i]} {_EVIDENCE[(i + 2) % 5]} {_BURDENS[(i + 3) % 5]}", None, "campaign_paraphrase") for i in range(4)]
    texts += [(t, o, "substantive_answered") for o, t in ANSWERED] + [(t, o, "substantive_unanswered") for o, t in UNANSWERED]
    texts += [("See attached.", "Blank Page Partners", "empty")]
    texts += [(f"I have crewed on the night boat for {rng.randint(3, 30)} winters and the idea seems {('poor', 'fine')[i % 2]} to me. Talk to deckhands before deciding.", None, "singleton_low") for i in range(6)]
    return [(f"{DOCKET}-{i:05d}", t, o, k) for i, (t, o, k) in enumerate(texts, 1)]


def build(spark: SparkSession) -> DataFrame:
    """comment_id, docket_id, full_text, organization, truth."""
    return spark.createDataFrame(rows(), "comment_id string, full_text string, organization string, truth string").withColumn("docket_id", F.lit(DOCKET))


def final_document(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("SAMPLE-FINAL", FINAL, None)], "document_id string, text string, xml string")


def run(spark: SparkSession) -> dict[str, DataFrame]:
    """The stages over the sample: comments, dedup, responses, clusters, links."""
    from rostrum.storage import cut

    comments = cut(build(spark), "comments")
    dedup = cut(campaigns.detect(comments), "dedup")
    responses = cut(parsing.parse_responses(final_document(spark)), "responses")
    units = comments.join(dedup.drop("docket_id"), "comment_id").where("campaign_id is null or is_exemplar").select("docket_id", F.col("comment_id").alias("id"), F.col("full_text").alias("text"))
    both = units.unionByName(responses.select(F.lit(DOCKET).alias("docket_id"), F.col("response_id").alias("id"), F.concat_ws(" ", "comment_para", "response_para").alias("text")))
    weights = cut(linkage.tfidf(both), "weights")
    ours, theirs = weights.join(units.select("id"), "id"), weights.join(responses.select(F.col("response_id").alias("id")), "id")
    clusters = linkage.clusters(cut(linkage.tfidf(units), "weights"), units.select("docket_id", "id"))
    # pairs without a common term score 0: they count for the mean and deviation, so all pairs are filled in against the few responses
    scores = linkage.sparse_similarities(ours, theirs)
    filled = units.select(F.col("id").alias("x")).join(F.broadcast(responses.select(F.col("response_id").alias("y")))).join(scores, ["x", "y"], "left")
    links = linkage.best_links(filled.select(F.col("x").alias("comment_id"), F.col("y").alias("response_id"), F.coalesce("score", F.lit(0.0)).alias("score")))
    return {"comments": comments, "dedup": dedup, "responses": responses, "clusters": clusters, "links": links}


def score(stages: dict[str, DataFrame]) -> dict[str, float]:
    """Share of each truth label that came out as it should; 1.0 everywhere but for paraphrases caught by shingles: 0.0."""
    joined = stages["comments"].select("comment_id", "truth").join(stages["dedup"], "comment_id", "left")
    joined = joined.join(stages["clusters"].select(F.col("id").alias("comment_id"), "cluster_id"), "comment_id", "left").join(stages["links"].select("comment_id", "response_id"), "comment_id", "left")
    share = lambda truth, test: F.avg(F.when(F.col("truth").startswith(truth), test.cast("double")))
    inside, linked = F.col("campaign_id").isNotNull(), F.col("response_id").isNotNull()
    return joined.agg(
        share("campaign_exact", inside).alias("exact_campaign_caught"), share("campaign_near", inside).alias("near_campaign_caught"),
        share("campaign_near", F.col("insert_text").isNotNull()).alias("near_inserts_recovered"), share("campaign_paraphrase", inside).alias("paraphrase_caught_by_shingles"),
        share("campaign_paraphrase", F.coalesce("cluster_id", F.lit(-1)) >= 0).alias("paraphrase_grouped_by_terms"), share("substantive", ~inside).alias("substantive_not_swept_into_campaign"),
        share("substantive_answered", linked).alias("answered_linked"), share("substantive_unanswered", ~linked).alias("unanswered_correctly_unlinked"),
    ).first().asDict()


