"""Statement pages: classification by title, density and vocabulary; scores; the pages to read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary import registry as R
from granary.functions.text import has_any, heading_shaped, let, lines, ordered, section_type, top_lines, trim

# Fixed value: numbers as statements print them.
FINANCIAL_NUMBER = r"\d{1,3}(?:,\d{3})+(?:\.\d{1,2})?|\d+\.\d{2}(?!\s*%)"


def _kind(line: Column) -> Column:
    return let(F.lower(line), lambda low: ordered([(t, has_any(low, words)) for t, words in R.TITLES]))


def _cell_like(line: Column) -> Column:
    def like(s: Column) -> Column:
        n = F.length(s)
        return (n > 0) & (n <= 20) & (n - F.regexp_count(s, F.lit(r"\p{L}")) >= n * 0.5) & s.rlike(r"(?U)\d")

    return let(trim(line), like)


def classify(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, statement_type, section_type, score, numeric_count. One projection, no shuffle.

    A statement needs five financial numbers. Its type is that of the first title-like line with a title
    phrase; a line after a bare note number (1 to 60) is no title. Failing that, of the first line with a
    phrase. Other pages are notes, mda or other by their body. NULL text counts as empty."""
    p = pages.select("doc_id", "page_no", F.coalesce("text", F.lit("")).alias("text"))

    def of_page(text: Column) -> Column:
        return let(F.regexp_count(text, F.lit(FINANCIAL_NUMBER)), lambda n: F.when(n >= R.LEAST_NUMBERS, _dense(text, n)).otherwise(_sparse(text, n)))

    # One expression per page, and a generator over it: a filter on the type is not pushed into it and computed again.
    return p.select("doc_id", "page_no", F.inline(F.array(let(F.col("text"), of_page))))


def _told(kind: Column, text: Column, score: Column, n: Column) -> Column:
    return F.struct(kind.alias("statement_type"), section_type(text).alias("section_type"), score.alias("score"), n.alias("numeric_count"))


def _sparse(text: Column, n: Column) -> Column:
    """A page with few numbers: its kind by its body."""
    return _told(let(F.lower(text), lambda body: ordered([(k, has_any(body, ws)) for k, ws in R.NARRATIVE], "other")), text, F.lit(0.0), n)


def _dense(text: Column, n: Column) -> Column:
    """A page with numbers enough: its lines are bound once, so work grows with them."""

    def of_lines(ls: Column) -> Column:
        def titled(x: Column, i: Column) -> Column:
            bare = F.regexp_replace(trim(F.get(ls, i - 1)), r"\.+$", "")
            return heading_shaped(x) & ~((i > 0) & F.coalesce(bare.rlike(r"^0*([1-9]|[1-5][0-9]|60)\z"), F.lit(False)))

        return let(F.filter(ls, titled), lambda titles: of_titles(ls, titles))

    def of_titles(ls: Column, titles: Column) -> Column:
        first = lambda xs: F.get(F.filter(F.transform(xs, _kind), lambda k: k.isNotNull()), F.lit(0))
        kinds = let(first(titles), lambda strong: F.struct(strong.alias("strong"), F.coalesce(strong, first(ls)).alias("kind")))
        return let(kinds, lambda k: F.when(k["kind"].isNull(), _sparse(text, n)).otherwise(_told(k["kind"], text, score(ls, titles, k["strong"], k["kind"]), n)))

    def quality(titles: Column, words: list[str]) -> Column:
        rate = lambda low: F.greatest(*[F.when(low.contains(w), F.when(F.length(low) - len(w) <= 10, 2).otherwise(1)).otherwise(0) for w in words])
        return F.coalesce(F.array_max(F.transform(titles, lambda x: let(F.lower(trim(x)), rate))), F.lit(0))

    def score(ls: Column, titles: Column, strong: Column, kind: Column) -> Column:
        heading = reduce(lambda acc, t: F.when(strong == t[0], quality(titles, t[1])).otherwise(acc), R.TITLES, F.lit(0))
        cells = F.size(F.filter(ls, _cell_like)) / F.greatest(F.size(ls), F.lit(1))
        totals = F.size(F.filter(ls, lambda x: x.rlike(r"(?iU)^\s*total\b")))
        share = lambda body, ws: sum((body.contains(w).cast("int") for w in ws), F.lit(0)) / float(len(ws))
        words = let(F.lower(text), lambda body: reduce(lambda acc, t: F.when(kind == t[0], share(body, t[1])).otherwise(acc), R.CHECKLIST.items(), F.lit(0.0)))
        currency = text.rlike(r"(?iu)₹|in crore|in lakh|rs\.|inr").cast("double")
        w = R.WEIGHTS
        return (
            w["heading"] * heading + w["numbers"] * (F.least(n, F.lit(R.NUMBERS_CAP)) / R.NUMBERS_CAP) + w["cells"] * cells
            + w["totals"] * (F.least(totals, F.lit(R.TOTALS_CAP)) / R.TOTALS_CAP) + w["checklist"] * words + w["currency"] * currency
        )

    return let(F.filter(lines(text), lambda x: F.length(trim(x)) > 0), of_lines)


def select_pages(classes: DataFrame) -> DataFrame:
    """doc_id, statement_type, ord, page_no: the best page of each statement, earliest of equals; for
    cash_flow the next one too, whether or not it exists."""
    best = classes.filter(F.col("statement_type").isin(*R.STATEMENTS)).groupBy("doc_id", "statement_type").agg(F.max_by("page_no", F.struct("score", -F.col("page_no"))).alias("page"))
    wanted = F.when(F.col("statement_type") == "cash_flow", F.array("page", F.col("page") + 1)).otherwise(F.array("page"))
    return best.select("doc_id", "statement_type", F.posexplode(wanted).alias("ord", "page_no"))


def page_blocks(selected: DataFrame, pages: DataFrame, most: int = 10_000) -> DataFrame:
    """doc_id, statement_type, block: selected pages that exist, each under its separator, cut at ``most``."""
    with_text = selected.join(pages.select("doc_id", "page_no", "text"), ["doc_id", "page_no"])
    part = F.concat(F.lit("\n--- Page "), F.col("page_no").cast("string"), F.lit(" ---\n"), F.coalesce("text", F.lit("")))
    parts = with_text.groupBy("doc_id", "statement_type").agg(F.array_sort(F.collect_list(F.struct("ord", part.alias("part")))).alias("parts"))
    return parts.select("doc_id", "statement_type", F.substring(F.array_join(F.transform("parts", lambda x: x["part"]), ""), 1, most).alias("block"))


def tag_tables(tables: DataFrame, classes: DataFrame) -> DataFrame:
    """Tables with their page's statement_type, and its section where theirs is unknown."""
    c = classes.select("doc_id", "page_no", "statement_type", F.col("section_type").alias("_section"))
    out = tables.join(c, ["doc_id", "page_no"], "left")
    section = F.when((F.col("section_hint") == "unknown") & (F.col("_section") != "unknown"), F.col("_section")).otherwise(F.col("section_hint"))
    return out.withColumn("section_hint", section).drop("_section")


def content_gate(pages: DataFrame, words: list[str] = R.FINANCIAL_WORDS, most_pages: int = R.GATE_PAGES) -> DataFrame:
    """doc_id, has_content: whether any of the first pages says any of the words."""
    hit = (F.col("page_no") <= most_pages) & has_any(F.lower(F.coalesce("text", F.lit(""))), words)
    return pages.groupBy("doc_id").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("has_content"))


def document_years(pages: DataFrame) -> DataFrame:
    """doc_id, years: the first four distinct years in the top twelve lines of the first five pages."""
    from granary.functions.text import header_years

    top = top_lines(F.coalesce("text", F.lit("")), 12)
    p = pages.filter("page_no <= 5").select("doc_id", "page_no", header_years(top).alias("y"))
    p = p.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "y"))).alias("all"))
    return p.select("doc_id", F.slice(F.array_distinct(F.flatten(F.transform("all", lambda x: x["y"]))), 1, 4).alias("years"))


# What a company name line says, and what it doesn't.
_SKIP = (r"(?iU)(bse|nse|bombay stock|national stock|dalal|phiroze|sebi|limited liability|cin\s*:|gstin|pan\s*:|website|www\.|\d{1,2}[\s,/]\d{1,2}[\s,/]\d{2,4}|"
         r"dear|subject|ref\s*:|mumbai|chennai|delhi|kolkata|hyderabad|august|january|february|march|april|may|june|july|september|october|november|december)")  # fmt: skip
_SUFFIX = r"(?iU)\blimited\b|\bltd\.?\b"


def company_names(pages: DataFrame) -> DataFrame:
    """doc_id, company_name: most frequent name-like line with a company suffix in the first three pages; of
    equally frequent ones the shortest, then the first seen."""
    p = pages.filter("page_no <= 3").select("doc_id", "page_no", F.posexplode(F.transform(lines(F.coalesce("text", F.lit(""))), trim)).alias("pos", "line"))
    named = p.filter((F.length("line") > 5) & (F.length("line") <= 80) & ~F.col("line").rlike(_SKIP) & F.col("line").rlike(_SUFFIX) & F.col("line").rlike(r"^[\p{Lu}\p{Lt}]"))
    name = trim(F.regexp_replace("line", r"(?iU)^(for and on behalf of|for)\s+", ""))
    votes = named.groupBy("doc_id", name.alias("company_name")).agg(F.count(F.lit(1)).alias("votes"), F.min(F.struct("page_no", "pos")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("votes"), F.length("company_name"), "first"))
    return votes.withColumn("_r", rank).filter("_r = 1").select("doc_id", "company_name")
