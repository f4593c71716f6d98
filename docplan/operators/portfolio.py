"""Several analysed documents about one matter, read together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docplan.functions import lexicon as L
from docplan.functions import spans as S
from docplan.functions.rows import table_of
from docplan.functions.storage import settled

MIN_DOCUMENTS = 2
COMPARABLE = ("year", "score", "cgpa", "age", "category")
#: Documents of one word that a block of the index holds.
BLOCK = 4096


def portfolio_sizes(members: DataFrame, max_documents: int | None = None) -> DataFrame:
    """portfolio_id, n_documents and the reason of its refusal, if it is refused."""
    sizes = members.groupBy("portfolio_id").agg(F.count_distinct("doc_id").alias("n_documents"))
    too_many = f"WHEN n_documents > {max_documents} THEN 'too many documents'" if max_documents else ""
    return sizes.selectExpr(
        "*", f"CASE WHEN n_documents < {MIN_DOCUMENTS} THEN 'too few documents' {too_many} END as refusal")


def valid_portfolios(members: DataFrame, max_documents: int | None = None) -> DataFrame:
    """Members of portfolios of two or more distinct documents, of any number unless limited.

    Sizes come from partial aggregates, so a refused portfolio is turned away
    without its documents ever meeting in one task; ``portfolio_sizes`` lists why.
    """
    accepted = portfolio_sizes(members, max_documents).where("refusal IS NULL").select("portfolio_id")
    return members.join(accepted, "portfolio_id", "left_semi")


def subject(title: str, requirements: str, schedule: str) -> str:
    """Words that name what a document is about."""
    parts = (
        f"concat(array({title}.value), {S.transform(requirements, lambda r: f'{r}.text')}, "
        f"{S.transform(schedule, lambda s: f'{s}.description')})"
    )
    return S.token_set(f"array_join({parts}, ' ')", 4, L.SUBJECT_FILLER)


def comparable(criteria: str) -> str:
    """The first comparable criterion of each attribute."""
    usable = S.keep(
        criteria,
        lambda c: f"{c}.comparator != 'not_comparable' AND {c}.attribute IN {COMPARABLE}",
    )
    return S.first_per_key(usable, lambda c: f"{c}.attribute")


def compact(analysed: DataFrame, *more: str) -> DataFrame:
    """What the comparisons need of each analysed document, and the columns asked for."""
    return analysed.selectExpr(
        "doc_id",
        f"{subject('title', 'requirements', 'schedule')} as subject",
        "primary_deadline.value as due",
        f"{comparable('criteria')} as criteria", *more,
    )


def portfolio_rows(members: DataFrame, analysed: DataFrame) -> DataFrame:
    """Each document of a valid portfolio with its compact findings, written once: comparisons read it often."""
    found = analysed if "subject" in analysed.columns else compact(analysed)
    return settled(valid_portfolios(members).join(found, "doc_id").select(
        "portfolio_id", "pos", "doc_id", "name", "subject", "due", "criteria"
    ))


def related_pairs(portfolios: DataFrame, at_least: float = 0.0) -> DataFrame:
    """Documents of a portfolio that share subject words, ``l`` before ``r``, with their overlap.

    The overlap is the shared part of the smaller subject. Pairs come from an
    index of words, so documents without a common word never meet. A pair at
    ``at_least`` shares that part of the smaller subject, so it also shares one
    of the smaller one's rarest words if only its most common ones, fewer than
    that part, are left out; those are not looked up. A word of very many
    documents is looked up in blocks of them.
    """
    key, portfolios = ["portfolio_id", "at"], portfolios.withColumn("at", F.struct("pos", "doc_id"))
    words = portfolios.select(*key, F.size("subject").alias("n"), F.explode("subject").alias("word"))
    counts = words.groupBy("portfolio_id", "word").agg(F.count("*").alias("f"))
    rarest = W.partitionBy(*key).orderBy("f", "word")  # the words of one document
    ranked = words.join(counts, ["portfolio_id", "word"]).withColumn("rank", F.row_number().over(rarest)).where("f > 1")
    blocks = F.expr(f"1 + f div {BLOCK}")
    needed = f"greatest(1, cast(ceil({at_least}D * n - 1e-9) as int))"
    probes = ranked.where(f"rank <= n - {needed} + 1").select(
        "portfolio_id", "word", F.col("at").alias("at_s"), F.col("n").alias("n_s"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("block"))
    index = ranked.select("portfolio_id", "word", "at", "n", F.pmod(F.xxhash64("at"), blocks).alias("block"))
    met = probes.join(index, ["portfolio_id", "word", "block"]).where("n_s < n OR n_s = n AND at_s < at")
    pairs = met.select(
        "portfolio_id", F.least("at_s", "at").alias("at_l"), F.greatest("at_s", "at").alias("at_r")).distinct()
    side = lambda end: portfolios.select(
        "portfolio_id", F.col("at").alias(f"at_{end}"), F.struct("doc_id", "name", "subject", "due", "criteria").alias(end))
    both = pairs.join(side("l"), ["portfolio_id", "at_l"]).join(side("r"), ["portfolio_id", "at_r"])
    return both.withColumn("related", F.expr(overlap_coefficient("l.subject", "r.subject"))).where(
        f"related > 0 AND related >= {at_least}D").select("portfolio_id", "l", "r", "related")


def overlap_coefficient(a: str, b: str) -> str:
    shared = f"size(array_intersect({a}, {b}))"
    smaller = f"least(size({a}), size({b}))"
    return f"if({smaller} = 0, 0D, {shared} / cast({smaller} as double))"


def subject_overlap(portfolios: DataFrame) -> DataFrame:
    """Overlap of all pairs that share a word; all others have none."""
    return related_pairs(portfolios).selectExpr(
        "portfolio_id", "l.doc_id as left_id", "r.doc_id as right_id", "round(related, 3) as relatedness",
        f"related >= {S.lit(L.SAME_SUBJECT_AT)} as same_subject",
    )


# What a reader is told about a disagreement.
DUE_SUMMARY = "Two documents about the same process state different deadlines: "
DUE_ADVICE = ("Work to ", " until the issuing office confirms which is current. The earlier date is the only one "
              "that cannot cost you the opportunity if it turns out to be the right one.")
BAR_SUMMARY = "The two documents set different eligibility on "
BAR_ADVICE = ("Assume the stricter of the two until the issuing office says otherwise, and ask which document "
              "supersedes the other.")


def deadline_conflicts(portfolios: DataFrame) -> DataFrame:
    """Different primary deadlines in documents about the same subject."""
    early, late = "least(l.due, r.due)", "greatest(l.due, r.due)"
    return related_pairs(portfolios, L.SAME_SUBJECT_AT).where("l.due != r.due").selectExpr(
        "portfolio_id", "l.doc_id as left_id", "r.doc_id as right_id", "l.due as left_due", "r.due as right_due",
        "round(related, 3) as relatedness",
        f"concat({S.lit(DUE_SUMMARY)}, {S.human_date(early)}, ' in ', if(l.due < r.due, l.name, r.name), ', ', "
        f"{S.human_date(late)}, ' in ', if(l.due < r.due, r.name, l.name), '.') as summary",
        f"concat({S.lit(DUE_ADVICE[0])}, {S.human_date(early)}, {S.lit(DUE_ADVICE[1])}) as resolution",
    )


def eligibility_conflicts(portfolios: DataFrame) -> DataFrame:
    """Different bars on one attribute in documents about the same subject."""
    both = related_pairs(portfolios, L.SAME_SUBJECT_AT).selectExpr("*", "explode(l.criteria) as c").selectExpr(
        "*", "try_element_at(filter(r.criteria, o -> o.attribute = c.attribute), 1) as o")
    differ = "NOT (c.num_value <=> o.num_value AND c.accepted <=> o.accepted AND c.comparator = o.comparator)"
    return both.where(f"o IS NOT NULL AND {differ}").selectExpr(
        "portfolio_id", "l.doc_id as left_id", "r.doc_id as right_id", "c.attribute",
        "c.requirement as left_requirement", "o.requirement as right_requirement", "round(related, 3) as relatedness",
        f"concat({S.lit(BAR_SUMMARY)}, c.attribute, ': ', c.requirement, ' in ', l.name, ', ', o.requirement, ' in ', "
        "r.name, '.') as summary", f"{S.lit(BAR_ADVICE)} as resolution",
    )


def portfolio_steps(members: DataFrame, analysed: DataFrame) -> DataFrame:
    steps = table_of(analysed, "schedule", "doc_id").select(
        "doc_id", "action_id", "ord", "description", "latest_start", "effective_deadline",
        "deadline",
    )
    return valid_portfolios(members).join(steps, "doc_id")


def merged_timeline(steps: DataFrame) -> DataFrame:
    """All dated steps of a portfolio by the day they have to start."""
    order = W.partitionBy("portfolio_id").orderBy("latest_start", "name", "ord", "doc_id")
    return steps.where("latest_start IS NOT NULL").withColumn("pos", F.row_number().over(order))


def undated_steps(steps: DataFrame) -> DataFrame:
    order = W.partitionBy("portfolio_id").orderBy("name", "ord", "doc_id")
    return steps.where("latest_start IS NULL").withColumn("pos", F.row_number().over(order))


def portfolio_summary(members: DataFrame, steps: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Consistency, the next date to finish by, the next date a document states, of each valid portfolio.

    A portfolio without steps or conflicts has no dates and is consistent.
    """
    valid = portfolio_sizes(members).where("refusal IS NULL").select("portfolio_id")
    dated = steps.groupBy("portfolio_id").agg(
        F.expr("min(effective_deadline) FILTER (WHERE latest_start IS NOT NULL)").alias("next_due"),
        F.expr("min(deadline) FILTER (WHERE latest_start IS NOT NULL)").alias(
            "next_stated_deadline"
        ),
    )
    disputed = conflicts.select("portfolio_id").distinct().withColumn("disputed", F.lit(True))
    return valid.join(dated, "portfolio_id", "left").join(disputed, "portfolio_id", "left").selectExpr(
        "portfolio_id", "next_due", "next_stated_deadline",
        "NOT coalesce(disputed, false) as is_consistent",
    )
