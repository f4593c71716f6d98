"""Notices derived from the ``orders`` table, one document per order.

The supplied texts contain no instructions, so each order is rendered into one
of twelve notice templates with its own dates, artefacts and thresholds. The
SQL here is plain enough to run on Spark and on another engine, which lets a
check rebuild the texts and compute the expected findings from the columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docplan.functions import lexicon as L

TODAY = "date'1998-06-15'"

ARTEFACTS = (
    "income certificate", "caste certificate", "transfer certificate", "bonafide certificate",
    "previous marksheet", "experience letter",
)
PLACES = ("Tamil Nadu", "Kerala", "West Bengal", "Goa")
UNITS = ("days", "working days", "weeks", "months")


def _pick(index: str, values) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {index} {arms} END"


def month_name(value: str) -> str:
    arms = " ".join(f"WHEN {i + 1} THEN '{m.capitalize()}'" for i, m in enumerate(L.MONTHS))
    return f"CASE month({value}) {arms} END"


def day_month(value: str) -> str:
    return f"concat(CAST(day({value}) AS STRING), ' ', {month_name(value)})"


def long_date(value: str) -> str:
    return f"concat({day_month(value)}, ' ', CAST(year({value}) AS STRING))"


def month_day(value: str) -> str:
    return (
        f"concat({month_name(value)}, ' ', CAST(day({value}) AS STRING), ', ', "
        f"CAST(year({value}) AS STRING))"
    )


def numeric_date(value: str) -> str:
    return (
        f"concat(lpad(CAST(day({value}) AS STRING), 2, '0'), '/', "
        f"lpad(CAST(month({value}) AS STRING), 2, '0'), '/', CAST(year({value}) AS STRING))"
    )


#: Columns each template draws on.
PARTS = {
    "doc_id": "o_orderkey",
    "cust": "o_custkey",
    "tpl": "o_orderkey % 12",
    "issued": "CAST(o_orderdate AS DATE)",
    "opens": "CAST(o_orderdate AS DATE) + 1",
    "due": "CAST(o_orderdate AS DATE) + 14",
    "art1": _pick("o_custkey % 6", ARTEFACTS),
    "art2": _pick("(o_custkey + 1) % 6", ARTEFACTS),
    "n": "CAST(o_orderkey % 9 + 2 AS INT)",
    "unit": _pick("o_custkey % 4", UNITS),
    "marks": "CAST(40 + o_orderkey % 50 AS INT)",
    "cgpa": "CAST(5 + o_custkey % 4 AS INT)",
    "half": "CASE WHEN o_orderkey % 24 < 12 THEN '.5' ELSE '' END",
    "age": "CAST(16 + o_orderkey % 30 AS INT)",
    "place": _pick("o_custkey % 4", PLACES),
    "variant": "CAST(o_custkey % 3 AS INT)",
    "added": "''",
}

#: A reissue moves the due date by -4 to +4 days and sometimes asks for more.
REISSUED = {
    **PARTS,
    "due": "CAST(o_orderdate AS DATE) + CAST(10 + o_orderkey % 9 AS INT)",
    "added": "CASE WHEN o_orderkey % 5 = 0 THEN ', bank statement' ELSE '' END",
}

#: Sentences by name; the templates below put them together.
SENTENCES = {
    "dated": f"concat('Dated ', {long_date('issued')}, '.')",
    "along": "concat('Every boarder has to deposit the allotment form along with the ', art1, "
             f"added, ' and ', art2, ' before ', {long_date('due')}, '.')",
    "upload": f"concat('Candidates should upload the ', art1, ' by ', {day_month('due')}, '.')",
    "furnish": "concat('Applicants are required to furnish the ', art1, ' not later than ', "
               f"{month_day('due')}, '.')",
    "collect": f"concat('The fee receipt must be collected before ', {numeric_date('due')}, '.')",
    "complete": "concat('Registrations must be completed within ', CAST(n AS STRING), ' ', unit, "
                "' of this circular.')",
    "apply": f"concat('Students may apply from ', {long_date('opens')}, ' to ', "
             f"{long_date('due')}, ' for admission.')",
    "apply_reversed": f"concat('Students may apply from ', {long_date('due')}, ' to ', "
                      f"{long_date('opens')}, ' for admission.')",
    "chain": "concat('Collect the ', art1, ', sign the hostel undertaking and deposit it at the counter.')",
    "send": f"concat('Send the ', art1, ' to the registrar before ', {long_date('due')}, '.')",
    "attach": "concat('If you hold a sports quota seat, you must attach the fee "
              f"challan by ', {long_date('due')}, '.')",
    "outside": "'Employees holding a lab key must return the equipment declaration.'",
    "sample": "'Candidates are encouraged, but not obliged, to upload a sample portfolio.'",
    "portal": "concat('Use the online portal', CASE WHEN variant = 0 THEN "
              "' (admissions.example.edu)' ELSE '' END, ' for queries.')",
    "vague": "'Submit the prescribed form to the concerned office before the last date.'",
    "shortly": "'Details will be announced shortly.'",
    "limits": "concat('Open to SC/ST category students of the second year and above with minimum ', "
              "CAST(marks AS STRING), '% marks and CGPA of ', CAST(cgpa AS STRING), half, '.')",
    "limits2": "concat('Applicants must be at least ', CAST(age AS STRING), "
               "' years of age and residents of ', place, ' only.')",
    "degree": "'Only those with B.Tech are eligible.'",
    "prose": "concat('The hall was built in 1920 and has ', CAST(doc_id AS STRING), "
             "' seats. Visitors often walk there in the evening.')",
    "duties": "'Key duties and responsibilities are listed below. Qualifications: at least 3 years "
              "of experience in Java. Salary package as per norms.'",
    "force": f"concat('This policy comes into force on ', {long_date('issued')}, "
             "'. Clause 4 is applicable to all employees.')",
}

_GAP, _NL = "concat(chr(10), chr(10))", "chr(10)"


def _document(heading: str, *names: str, sep: str = _GAP) -> str:
    parts = [heading, _GAP]
    for i, name in enumerate(names):
        parts += ([sep] if i else []) + [SENTENCES[name]]
    return f"concat({', '.join(parts)}, {_NL})"


TEMPLATES = {
    0: _document("concat('NOTICE NO. ', CAST(doc_id AS STRING))", "dated", "along"),
    1: _document("'CIRCULAR'", "upload"),
    2: _document("'Notice to applicants'", "furnish"),
    3: f"concat('EXAMINATION NOTICE', {_GAP}, {SENTENCES['collect']}, ' Ref 31/31/1998.', {_NL})",
    4: _document("'CIRCULAR'", "dated", "complete"),
    5: "CASE WHEN cust % 5 = 0 THEN " + _document("'ADMISSION NOTICE'", "apply_reversed")
       + " ELSE " + _document("'ADMISSION NOTICE'", "apply") + " END",
    6: _document("'PLACEMENT CIRCULAR'", "chain", "send", sep="' '"),
    7: _document("'APPLICATION CIRCULAR'", "attach", "outside", "sample", sep="' '"),
    8: _document("'REGISTRATION NOTICE'", "portal", "vague", "shortly"),
    9: _document("'SCHOLARSHIP NOTICE'", "limits", "limits2", "degree"),
    10: "CASE variant WHEN 0 THEN " + _document("'History of the hall'", "prose")
        + f" WHEN 1 THEN concat('APPLICATION FORM', {_GAP}, 'Name: ______', {_NL}, "
        f"'Signature: ______', {_NL}, 'For office use only', {_NL})"
        + " ELSE " + _document("'Leave policy'", "force") + " END",
    11: _document("'Job description: backend engineer'", "duties"),
}
TEXT = "CASE tpl " + " ".join(f"WHEN {i} THEN {t}" for i, t in TEMPLATES.items()) + " END"
SOURCE_KIND = "CASE WHEN doc_id % 7 = 0 THEN 'image' ELSE 'plain_text' END"
TEXT_CONFIDENCE = "CAST(CASE WHEN doc_id % 7 = 0 THEN 0.61 ELSE 1.0 END AS DOUBLE)"


def spread(df: DataFrame, key: str = "o_orderkey") -> DataFrame:
    """Deals rows by their key to four tasks a core, or the shuffle partitions if they are more.

    An input file of few row groups is read by as few tasks, which would then render and analyse all texts.
    Only the narrow columns travel, and joins on the key that follow need no further shuffle. The session's
    ``docplan.input.partitions`` sets another number.
    """
    session = df.sparkSession
    number = session.conf.get("docplan.input.partitions", None) or max(
        4 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(int(number), key)


def notices(spark: SparkSession, sf_dir: str, parts: dict[str, str] = PARTS) -> DataFrame:
    """``doc_id, text, text_confidence, source_kind`` plus the columns of the template."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    orders = spread(orders.select("o_orderkey", "o_custkey", "o_orderdate"))
    return orders.selectExpr(*[f"{e} as {name}" for name, e in parts.items()]).selectExpr(
        "*", f"{TEXT} as text", f"{TEXT_CONFIDENCE} as text_confidence",
        f"{SOURCE_KIND} as source_kind",
    )


def plain_notices(
    spark: SparkSession, sf_dir: str, parts: dict[str, str] = PARTS
) -> DataFrame:
    return notices(spark, sf_dir, parts).select(
        "doc_id", "text", "text_confidence", "source_kind"
    )


def notices_sql(parts: dict[str, str] = PARTS) -> str:
    """The same table as a subquery over ``orders``, for checks in other engines."""
    columns = ", ".join(f"{e} AS {name}" for name, e in parts.items())
    return (
        f"SELECT *, {TEXT} AS text, {TEXT_CONFIDENCE} AS text_confidence, "
        f"{SOURCE_KIND} AS source_kind FROM (SELECT {columns} FROM orders) AS parts"
    )


#: Self-declared reader profiles, one per customer; about a seventh leave gaps.
PROFILE = {
    "year": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % 5 + 1 AS INT) END",
    "programme": "CASE WHEN c_custkey % 2 = 0 THEN 'B.Tech Computer Science' ELSE 'MBA' END",
    "category": _pick("c_custkey % 4", ("SC", "OBC", "General", "ST")),
    "domicile": _pick("(c_custkey + c_custkey % 3) % 4", PLACES),
    "score": "CAST(CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 40 + c_custkey % 55 END AS DOUBLE)",
    "cgpa": "CAST(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 5 + (c_custkey % 9) * 0.5 END "
            "AS DOUBLE)",
    "age": "CASE WHEN c_custkey % 7 = 3 THEN NULL ELSE CAST(15 + c_custkey % 40 AS INT) END",
}


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``profile_id`` and a ``profile`` struct of nullable fields."""
    fields = ", ".join(f"'{k}', {v}" for k, v in PROFILE.items())
    return spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(
        "c_custkey as profile_id", f"named_struct({fields}) as profile"
    )


def profiled_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each notice with the profile of the customer who placed the order."""
    docs = notices(spark, sf_dir).select(
        "doc_id", "text", "text_confidence", "source_kind", "cust"
    )
    readers = profiles(spark, sf_dir)
    return docs.join(readers, docs.cust == readers.profile_id).drop("cust")
