"""Uploads, pages and OCR reads turned into the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docplan.functions import spans as S

# Limits and thresholds of ingestion.
PAGE_BREAK = "\n\n"
SPARSE_PAGE_CHARS = 24
USABLE_OCR = 0.45
SNIFF_BYTES = 1024
ASCII_TEXT_RATIO = 0.7
IMAGE_SIGNATURES = (
    ("89504E470D0A1A0A", "PNG"), ("FFD8FF", "JPEG"), ("49492A00", "TIFF"), ("4D4D002A", "TIFF"),
    ("424D", "BMP"),
)
#: What the bytes 0x80-0x9F mean in Windows-1252; five of them mean nothing.
CP1252_HIGH = "€?‚ƒ„…†‡ˆ‰Š‹Œ?Ž??‘’“”•–—˜™š›œ?žŸ"


def read_notices(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, text`` from parquet; blank texts are refused."""
    docs = spark.read.parquet(path).select("doc_id", "text")
    return docs.where("rlike(text, r'(?U)\\S')")


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One document per file."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text")
    )
    return files.where("rlike(text, r'(?U)\\S')")


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def triage_uploads(
    files: DataFrame, max_bytes: int | None = None, max_chars: int | None = None
) -> DataFrame:
    """Kind of each upload by content, and why it is refused, if it is; of any size unless limited.

    Needs ``content``; the file name is never consulted.
    """
    head = f"substring(content, 1, {SNIFF_BYTES})"
    printable = (
        "length(regexp_replace(decode({h}, 'ISO-8859-1'), '[^\\\\x20-\\\\x7E\\\\n\\\\r\\\\t\\\\f]', ''))"
        " / cast(greatest(length({h}), 1) as double)"
    ).format(h=head)
    images = [
        (f"hex(substring(content, 1, {len(sig) // 2})) = '{sig}'", f"'image/{name}'")
        for sig, name in IMAGE_SIGNATURES
    ]
    blank = "rlike(decode(content, 'ISO-8859-1'), '\\\\A[\\\\x09-\\\\x0D\\\\x20]*\\\\z')"
    utf16 = "hex(substring(content, 1, 2)) IN ('FFFE', 'FEFF') AND length(content) % 2 = 0"
    kind = S.when(
        (blank, "'empty'"),
        ("hex(substring(content, 1, 5)) = '255044462D'", "'pdf'"),
        *images,
        ("hex(substring(content, 1, 4)) = '52494646' AND hex(substring(content, 9, 4)) = "
         "'57454250'", "'image/WEBP'"),
        (utf16, "'text/utf-16'"),
        (f"contains(decode({head}, 'ISO-8859-1'), chr(0))", "'binary'"),
        ("is_valid_utf8(cast(content as string))", "'text/utf-8'"),
        (f"{printable} >= {ASCII_TEXT_RATIO}D", "'text/single-byte'"),
        otherwise="'binary'",
    )
    reason = S.when(
        *([(f"length(content) > {max_bytes}", "'file is too large'")] if max_bytes else []),
        ("kind = 'empty'", "'file is empty'"),
        ("kind = 'binary'", "'looks like a binary format this engine cannot read'"),
        *([(f"startswith(kind, 'text/') AND char_length(text) > {max_chars}", "'text is too long'")]
          if max_chars else []),
    )
    kinds = files.selectExpr("*", f"{kind} as kind")
    decoded = kinds.selectExpr("*", f"{_decoded('content', 'kind')} as text")
    return decoded.selectExpr("*", f"{reason} as refusal")


def _decoded(content: str, kind: str) -> str:
    high = "".join(chr(c) for c in range(0x80, 0xA0))
    undefined = "".join(h for h, c in zip(high, CP1252_HIGH, strict=True) if c == "?")
    mapped = "".join(h if c == "?" else c for h, c in zip(high, CP1252_HIGH, strict=True))
    latin = f"decode({content}, 'ISO-8859-1')"
    single = (
        f"if(rlike({latin}, {S.lit('[' + undefined + ']')}), {latin}, "
        f"translate({latin}, {S.lit(high)}, {S.lit(mapped)}))"
    )
    utf8 = f"regexp_replace(decode({content}, 'UTF-8'), {S.lit(chr(92) + 'A' + chr(0xFEFF))}, '')"
    return S.when(
        (f"{kind} = 'text/utf-16'", f"decode({content}, 'UTF-16')"),
        (f"{kind} = 'text/utf-8'", utf8),
        (f"{kind} = 'text/single-byte'", single),
    )


def tidy(text: str) -> str:
    """Unix line ends, no blanks before them, at most one empty line in a row."""
    unix = S.replace(S.replace(text, r"\r\n", "\n"), r"\r", "\n")
    return S.replace(S.replace(unix, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")


def assembled(pages: str) -> str:
    """``{text, pages}`` from an array of ``{page, text}`` in page order."""

    def build(ps: str) -> str:
        starts = S.running_starts(
            S.transform(ps, lambda p: f"char_length({p}.text) + {len(PAGE_BREAK)}")
        )
        bounds = S.let(
            starts,
            lambda st: f"transform({ps}, "
            + S.lam(lambda p, i: S.struct(
                page=f"{p}.page", char_start=f"{st}[{i}]",
                char_end=f"{st}[{i}] + char_length({p}.text)",
            ), 2) + ")",
        )
        joined = f"array_join({S.transform(ps, lambda p: f'{p}.text')}, {S.lit(PAGE_BREAK)})"
        return S.struct(text=joined, pages=bounds)

    return S.let(pages, build)


def assemble_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, page, text) -> one document with its page bounds.

    A document is one value in the end, so its pages have to meet; a page
    table is shuffled once, on ``doc_id``.
    """
    grouped = pages.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("page", "text"))).alias("_pages")
    )
    return grouped.selectExpr("doc_id", f"{assembled('_pages')} as _d").selectExpr(
        "doc_id", "_d.text", "_d.pages"
    )


def page_of(pages: str, offset: str) -> str:
    """The page of an offset; a separator belongs to the page before it."""
    begun = S.keep(pages, lambda p: f"{p}.char_start <= {offset}")
    return f"element_at({begun}, -1).page"


def page_for_offset(spans: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds ``page`` to (doc_id, char_offset); offsets outside the text go."""
    bounds = documents.select("doc_id", "pages", F.char_length("text").alias("_n"))
    located = spans.join(bounds, "doc_id").where("char_offset >= 0 AND char_offset < _n")
    return located.selectExpr(
        "doc_id", "char_offset", f"{page_of('pages', 'char_offset')} as page"
    )


def ocr_words_to_pages(words: DataFrame) -> DataFrame:
    """Page text and confidence from OCR word boxes.

    (doc_id, page, word_no, block, par, line, word, conf). Blank words are
    dropped, a line ends where (block, par, line) changes, and confidence is
    the mean over words that were resolved. The unit grouped is one page image.
    """
    real = words.where("trim(word) != ''")
    grouped = real.groupBy("doc_id", "page").agg(
        F.array_sort(F.collect_list(F.struct("word_no", "block", "par", "line", "word"))).alias("w"),
        F.expr("coalesce(round(avg(conf) FILTER (WHERE conf >= 0) / 100, 4), 0D)").alias(
            "confidence"
        ),
    )

    def piece(w: str, i: str) -> str:
        same = " AND ".join(f"{w}.{f} = ws[{i} - 1].{f}" for f in ("block", "par", "line"))
        return (
            f"if({i} = 0, {w}.word, concat(if({same}, ' ', {S.lit(chr(10))}), {w}.word))"
        )

    text = S.let("w", lambda ws: f"array_join(transform({ws}, {S.lam(piece, 2)}), '')".replace(
        "ws[", f"{ws}["
    ))
    return grouped.selectExpr("doc_id", "page", f"{text} as text", "confidence")


def ocr_rollup(page_reads: DataFrame) -> DataFrame:
    """Sparse pages filled from usable OCR reads, and what that says of a document.

    (doc_id, page, native_text, ocr_text, ocr_conf) -> text, page bounds,
    kind, confidence and the pages still unreadable. Documents without any
    readable page are refused.
    """
    sparse = f"char_length(trim(native_text)) < {SPARSE_PAGE_CHARS}"
    usable = f"(sparse AND trim(coalesce(ocr_text, '')) != '' AND ocr_conf >= {USABLE_OCR}D)"
    filled = (
        page_reads.selectExpr("doc_id", "page", f"{tidy('native_text')} as native_text",
                              "ocr_text", "ocr_conf")
        .selectExpr("*", f"{sparse} as sparse")
        .selectExpr("*", f"{usable} as usable")
        .selectExpr(
            "doc_id", "page", "sparse", "usable", "ocr_conf",
            f"if(usable, {tidy('ocr_text')}, native_text) as text",
        )
    )
    grouped = filled.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("page", "text"))).alias("_pages"),
        F.expr("coalesce(round(avg(ocr_conf) FILTER (WHERE usable), 4), 1D)").alias(
            "text_confidence"
        ),
        F.expr("bool_and(sparse)").alias("_all_sparse"),
        F.expr(
            "array_sort(collect_list(page) FILTER (WHERE char_length(trim(text)) < "
            f"{SPARSE_PAGE_CHARS}))"
        ).alias("pages_needing_ocr"),
    )
    readable = grouped.where("exists(_pages, p -> trim(p.text) != '')")
    return readable.selectExpr(
        "*", f"{assembled('_pages')} as _d",
        "if(_all_sparse, 'scanned_pdf', 'native_pdf') as source_kind",
    ).selectExpr(
        "doc_id", "_d.text", "_d.pages", "source_kind", "text_confidence", "pages_needing_ocr"
    )


def fingerprint(docs: DataFrame) -> DataFrame:
    return docs.selectExpr(
        "doc_id", "sha2(text, 256) as content_hash", "left(sha2(text, 256), 16) as document_id"
    )


def reuploads(docs: DataFrame) -> DataFrame:
    """Every document that shares its text with another, with the first of them.

    Groups are aggregated to one row each before the join back, so a text that
    fills a third of the corpus costs one aggregation buffer, and its join
    partition is split by adaptive execution.
    """
    hashed = fingerprint(docs).select("doc_id", "content_hash")
    groups = (
        hashed.groupBy("content_hash")
        .agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc_id"))
        .where("copies > 1")
    )
    return hashed.join(groups, "content_hash")
