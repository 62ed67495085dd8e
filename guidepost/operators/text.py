"""Text mining as row expressions: filters, splitting, chunking, dictionary tagging.

Apart from page packing and the index along a document, nothing here shuffles: every
function adds columns or explodes a row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.periods import let
from ..functions.values import clean_text
from ..session import cut_lineage
from .ordered import blocked_running

MARK = "\u0001"
#: Pages of a document that one window task orders.
PAGE_BLOCK = 1024
#: Bytes of a word's beginning that are looked up at once.
GRAM = 4
#: Size of the table of beginnings, as a power of two.
SLOT_BITS = 14
#: Bytes of text that are searched in one step.
SEARCH_BLOCK = 1 << 20


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _occurrences(data: np.ndarray, starts: np.ndarray, words: Sequence[bytes]) -> np.ndarray:
    """Which of ``words`` (columns) occur in which text (rows); text ``i`` is
    ``data[starts[i]:starts[i + 1]]``.

    Four bytes at a time are looked up in a small table of the words' beginnings,
    whatever the number of words; only where one is met, its words are compared.
    """
    found = np.zeros((len(starts) - 1, len(words)), bool)
    short = [k for k, w in enumerate(words) if len(w) < GRAM]
    if short:
        for i in range(len(found)):
            text = data[starts[i]:starts[i + 1]].tobytes()
            found[i, short] = [words[k] in text for k in short]
    four = lambda w, at: np.uint32(int.from_bytes(w[at:at + GRAM], "little"))
    opened: dict[np.uint32, list[int]] = {}
    for k, w in enumerate(words):
        if len(w) >= GRAM:
            opened.setdefault(four(w, 0), []).append(k)
    kinds = np.array(sorted(opened), "<u4")
    if not len(kinds) or len(data) < GRAM:
        return found
    slot = lambda g: (g * np.uint32(2654435769)) >> np.uint32(32 - SLOT_BITS)
    table = np.zeros(1 << SLOT_BITS, bool)
    table[slot(kinds)] = True
    here = np.ndarray((len(data) - GRAM + 1,), "<u4", data, strides=(1,))  # the four bytes at every place
    for low in range(0, len(data), SEARCH_BLOCK):
        met = []
        for shift in range(low, low + GRAM):
            part = data[shift:shift + SEARCH_BLOCK]
            met.append(np.flatnonzero(table[slot(part[:len(part) // GRAM * GRAM].copy().view("<u4"))]) * GRAM + shift)
        at = np.concatenate(met)
        begins = here[at]
        kind = np.minimum(np.searchsorted(kinds, begins), len(kinds) - 1).astype(np.min_scalar_type(len(kinds)))
        true = kinds[kind] == begins
        at, kind = at[true], kind[true]
        by_kind = np.split(at[np.argsort(kind, kind="stable")], np.cumsum(np.bincount(kind, minlength=len(kinds)))[:-1])
        for g, places in zip(kinds, by_kind):
            for k in opened[g]:
                n, p = len(words[k]), places[places <= len(data) - len(words[k])]
                for off in {*range(GRAM, n - GRAM, GRAM), n - GRAM} - {0}:
                    p = p[here[p + off] == four(words[k], off)]
                text = np.searchsorted(starts, p, "right") - 1
                found[text[p + n <= starts[text + 1]], k] = True
    return found


def _search(texts: pa.Array, words: Sequence[str]) -> np.ndarray:
    """:func:`_occurrences` in the texts of an Arrow array; none in a null."""
    texts = texts.cast(pa.large_string())
    _, starts, data = texts.buffers()
    starts = np.frombuffer(starts, "<i8")[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, "<i8")
    return _occurrences(np.frombuffer(data or b"", "u1")[starts[0]:starts[-1]], starts - starts[0], [w.encode() for w in words])


def words_found(text: Column, words: Sequence[str]) -> Column:
    """Array of those of ``words`` that occur in the text, from one pass over it however
    many they are; null for a null text. ``text`` must be free of lambda functions (see
    :func:`..rows.computed_once`)."""
    words = list(dict.fromkeys(words))

    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        rows = _search(texts, words)
        return pa.array([[words[k] for k in np.flatnonzero(r)] if ok else None for r, ok in zip(rows, texts.is_valid().to_pylist())], pa.list_(pa.string()))

    return found(text)


def word_counts(text: Column, lists: Sequence[Sequence[str]]) -> tuple[Column, Callable[[Column, Sequence[str]], Column]]:
    """Array of how many words of each list occur in the text, from one pass over it as in
    :func:`words_found`, and what reads the number of a list from that array: ``count`` of
    :func:`hits` and the like."""
    lists = list(dict.fromkeys(map(tuple, lists)))
    words = list(dict.fromkeys(chain.from_iterable(lists)))
    member = np.array([[ws.count(w) for ws in lists] for w in words], "int32").reshape(len(words), len(lists))

    @F.arrow_udf("array<int>")
    def counts(texts: pa.Array) -> pa.Array:
        n = _search(texts, words).astype("int32") @ member
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype="int32") * len(lists)), pa.array(n.reshape(-1)))
        return pc.if_else(texts.is_valid(), flat, pa.scalar(None, flat.type))

    return counts(text), lambda c, ws: F.get(c, F.lit(lists.index(tuple(ws)))) if ws else F.lit(0)


def hits(text: Column, words: Sequence[str], count=None) -> Column:
    """How many of ``words`` occur in the (lower-case) text, as a flat sum. Here and below
    ``count`` reads the array of :func:`word_counts` in place of the text."""
    if count is not None:
        return count(text, words)
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def any_hit(text: Column, words: Sequence[str], count=None) -> Column:
    if count is not None:
        return count(text, words) > 0
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def word_hits(text: Column, words: Sequence[str]) -> Column:
    """As :func:`hits` but on whole words only."""
    return sum((F.rlike(text, F.lit(rf"\b\Q{w}\E\b")).cast("int") for w in words), F.lit(0))


def is_useful(text: Column, min_words: int = 5, boilerplate: Sequence[str] = L.BOILERPLATE) -> Column:
    n = F.length(text)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return (
        (n >= 20) & (F.size(words_of(text)) >= min_words)
        & ~F.startswith(text, F.lit("http")) & ~F.startswith(text, F.lit("www."))
        & (letters / F.greatest(n, F.lit(1)) >= 0.3)
        & ~(any_hit(F.lower(text), boilerplate) & (n < 200))
    )


def is_table_like(text: Column) -> Column:
    """More than 60% of at least three non-empty lines are short and mostly numeric."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    numeric = lambda x: (F.length(F.regexp_replace(x, r"[^0-9.,%\-₹() ]", "")) / F.length(x) > 0.7) & (F.length(x) < 100)
    n = F.size(lines)
    return (n > 2) & (F.size(F.filter(lines, numeric)) / F.greatest(n, F.lit(1)) > 0.6)


def is_meaningful(text: Column, min_words: int = 8) -> Column:
    return (F.size(words_of(text)) >= min_words) & ~F.rlike(F.lower(text), F.lit(r"^(confidential|disclaimer|page \d+|©)"))


def clean_paragraph(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"Page\s+\d+\s+of\s+\d+", ""))


def chunk(df: DataFrame, text: str, size: int = 3000, overlap: int = 400, drop_contained: bool = False) -> DataFrame:
    """Overlapping fixed-width pieces of every text: (chunk_index, chunk_start, chunk_text).

    ``drop_contained`` omits a tail that lies wholly inside the piece before it.
    """
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^\s+|\s+$", "")
    step = size - overlap
    last = F.length("__t") - (overlap if drop_contained else 0) - 1
    starts = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step))
    pieces = df.withColumn("__t", body).filter("__t <> ''").select(*df.columns, "__t", F.explode(starts).alias("chunk_start"))
    out = pieces.withColumn("chunk_text", F.substring(F.col("__t"), F.col("chunk_start") + 1, F.lit(size))).drop("__t")
    return out.filter(F.rlike("chunk_text", F.lit(r"\S"))).withColumn("chunk_index", (F.col("chunk_start") / step).cast("int"))


def document_index(chunks: DataFrame, doc: Sequence[str], order: Sequence[str], out: str = "chunk_index") -> DataFrame:
    """Index running over a whole document instead of over each block.

    The first column of ``order`` names the block (a page, a section), the others order
    its pieces: only counts of blocks are summed along a document.
    """
    return blocked_running(chunks, doc, order[:1], order[1:], {"__at": F.lit(1)}, totals=False).withColumnRenamed("__at", out)


def pack_pages(pages: DataFrame, doc: str, page: str, text: str, max_chars: int = 30000) -> DataFrame:
    """Consecutive pages joined until ``max_chars`` would be passed, then a new pack.

    Which page opens a pack depends on all earlier packs of its document. Every page
    points to the page that would open the next pack, found through cells of
    ``max_chars`` characters; pages reached from the first one by these pointers,
    doubled in each round, open packs. No task needs a whole document: groups are
    cells and blocks of pages, and there are as many rounds as the logarithm of the
    most packs of a document. ``page`` is a unique whole number in each document.
    """
    row = pages.select(F.col(doc).alias("doc"), F.col(page).cast("long").alias("page"), (F.coalesce(F.length(text), F.lit(0)) + 1).cast("long").alias("n"))
    block = F.floor(F.col("page") / PAGE_BLOCK)
    spans = cut_lineage(blocked_running(row.withColumn("block", block), ["doc"], ["block"], ["page"], {"at": F.col("n")}, totals=False).withColumn("end", F.col("at") + F.col("n")))

    starts = cut_lineage(_pack_starts(spans, max_chars))
    opens = spans.join(starts, ["doc", "at"], "left").withColumn("opens", F.col("start").isNotNull())
    # the count before a page plus its own opening, from 0
    numbered = blocked_running(opens.select("doc", "page", "block", "opens"), ["doc"], ["block"], ["page"], {"before": F.col("opens")}, totals=False)
    packs = numbered.select(F.col("doc").alias(doc), F.col("page").alias(page), (F.col("before") + F.col("opens").cast("long") - 1).alias("pack"))
    return pages.join(packs, [doc, page]).groupBy(doc, "pack").agg(
        F.count("*").alias("n_pages"), F.min(page).alias("first_page"), F.max(page).alias("last_page"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(page, text))), lambda x: x[text]), "\n").alias("pack_text"),
    )


def _pack_starts(spans: DataFrame, size: int) -> DataFrame:
    """(doc, at, start) of the pages that open a pack, given each page's ``at`` and ``end``."""
    # the page that holds character at + size opens the next pack: look it up in its cell
    cells = F.sequence(F.floor(F.col("at") / size), F.floor((F.col("end") - 1) / size))
    here = spans.select("doc", F.explode(cells).alias("cell"), F.struct("at", "end").alias("span"))
    here = here.select("doc", "cell", F.greatest(F.col("span.at"), F.col("cell") * size).alias("pos"), F.lit(0).alias("kind"), "span", F.lit(None).cast("long").alias("from"))
    asked = spans.select(
        "doc", (F.floor(F.col("at") / size) + 1).alias("cell"), (F.col("at") + size).alias("pos"), F.lit(1).alias("kind"),
        F.lit(None).cast("struct<at:bigint,end:bigint>").alias("span"), F.col("at").alias("from"))
    w = Window.partitionBy("doc", "cell").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = here.unionByName(asked).withColumn("hit", F.last("span", ignorenulls=True).over(w)).filter("kind = 1 and hit.end > pos")
    # a page larger than a pack fills one of its own
    to = F.when(F.col("hit.at") == F.col("from"), F.col("hit.end")).otherwise(F.col("hit.at"))
    jump = cut_lineage(found.select("doc", F.col("from").alias("at"), to.alias("to")))
    reached = cut_lineage(spans.filter("at = 0").select("doc", "at"))
    while True:
        new = reached.join(jump, ["doc", "at"]).select("doc", F.col("to").alias("at"))
        grown = cut_lineage(reached.unionByName(new).distinct())
        jump = cut_lineage(jump.join(jump.select("doc", F.col("at").alias("to"), F.col("to").alias("further")), ["doc", "to"]).select("doc", "at", F.col("further").alias("to")))
        reached = grown
        if jump.isEmpty():
            return reached.withColumn("start", F.lit(True))


def sentences_of(text: Column, long_limit: int = 1200, min_words: int = 8) -> Column:
    """Sentences of a cleaned text; long ones are cut again before common openers.

    A marker is written at each boundary and the text split on it, so no
    look-behind is needed.
    """
    cut = F.split(F.regexp_replace(text, r"([.!?])\s+(?=[A-Z0-9\"'(\-])", "$1" + MARK), MARK)
    again = lambda s: F.split(F.regexp_replace(s, r"\s+(?=(?:We|The company|This|Our|At|By)(?![\p{L}\p{N}_]))", MARK), MARK)
    parts = F.flatten(F.transform(F.transform(cut, lambda s: F.trim(s)), lambda s: F.when(F.length(s) <= long_limit, F.array(s)).otherwise(again(s))))
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.size(words_of(s)) >= min_words)


def sentences(df: DataFrame, text: str = "text", out: str = "sentence", **kw) -> DataFrame:
    return df.select(*[c for c in df.columns if c != text], F.posexplode(sentences_of(clean_text(F.col(text)), **kw)).alias("sentence_no", out))


# Patterns of speaker lines, titles and affiliations.
SPEAKER = (
    r"(?m)^([A-Z][A-Za-z .'\-]{2,50}?(?:\s*[(\[–\-]\s*(?:MD|CEO|CFO|COO|CRO|President|Director|Chairman|Managing Director|"
    r"Chief Executive|Chief Financial|Chief Operating|Head|VP|Vice President|Analyst|Moderator|Operator|Coordinator)[^)\]\n]*[)\]])?)\s*[:–]\s*"
)
TITLE = r"(?i)\b(MD|CEO|CFO|COO|CRO|President|Chairman|Managing Director|Chief Executive|Chief Financial|Chief Operating|Director|Head of|VP|Vice President)\b"
AFFILIATION = r"\b(analyst|research|investor|participant|moderator|operator|coordinator|securities|capital|financial services|broking|fund|asset management|advisors|equities)\b"


def speaker_blocks(df: DataFrame, text: str = "text", skip: Sequence[str] = L.NON_MANAGEMENT) -> DataFrame:
    """Transcript text to one row per speaker turn with name, title and first timestamp."""
    marked = F.regexp_replace(F.col(text), SPEAKER, MARK + "$1\u0002")
    turns = F.filter(F.split(marked, MARK), lambda b: F.contains(b, F.lit("\u0002")))
    one = df.select(*[c for c in df.columns if c != text], F.posexplode(turns).alias("block_no", "__b"))
    raw = F.trim(F.substring_index("__b", "\u0002", 1))
    body = F.regexp_replace(F.substring_index("__b", "\u0002", -1), r"^\s+|\s+$", "")
    title = F.nullif(F.trim(F.regexp_extract("speaker_raw", r"[(\[–\-]\s*([^)\]]+?)[)\]]", 1)), F.lit(""))
    name = F.trim(F.regexp_replace("speaker_raw", r"\s*[(\[–\-][^)\]]*[)\]]", ""))
    stamp = F.nullif(F.regexp_extract("block_text", r"\[?(\d{1,2}:\d{2}(?::\d{2})?)\]?", 1), F.lit(""))
    out = one.withColumns({"speaker_raw": raw, "block_text": body}).filter("block_text <> ''").drop("__b")
    return out.withColumns({
        "speaker_name": name, "speaker_title": title, "first_timestamp": stamp,
        "is_management": is_management(F.col("speaker_raw"), "transcript", skip=skip)})


def is_management(speaker: Column, variant: str = "transcript", skip: Sequence[str] = L.NON_MANAGEMENT, known: Sequence[str] = ()) -> Column:
    """Management-speaker test in three variants.

    ``transcript`` needs a title; ``registry`` also accepts known names and short
    plain names; ``promise`` only rejects marked or unknown speakers.
    """
    low = F.lower(F.trim(F.coalesce(speaker, F.lit(""))))
    if variant == "promise":
        return ~low.isin("", "unknown") & ~any_hit(low, skip)
    titled = F.rlike(speaker, F.lit(TITLE))
    if variant == "transcript":
        return ~any_hit(low, skip) & ~F.rlike(low, F.lit(r"\banalyst\b|\bresearch\b|\binvestor\b")) & titled
    plain = ~F.rlike(low, F.lit(r"\b(of|at|with|from|in|on)\b")) & (F.size(words_of(low)) < 4)
    return ~any_hit(low, skip) & ~F.rlike(low, F.lit(AFFILIATION)) & (any_hit(low, known) | titled | plain)


def tag_array(text: Column, dictionaries: Mapping[str, Mapping[str, Sequence[str]]]) -> Column:
    """``array<struct<type,name,keyword>>``: first keyword per tag found in the text.

    One conditional per tag over a literal dictionary, no join and no shuffle.
    """
    tags = []
    for kind, names in dictionaries.items():
        for name, words in names.items():
            first = F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words])
            tags.append(F.struct(F.lit(kind).alias("type"), F.lit(name).alias("name"), first.alias("keyword")))
    return F.filter(F.array(*tags), lambda t: t["keyword"].isNotNull())


# Patterns of time references and of numbers with units.
TIME_PATTERNS = [
    r"(?i)FY\s*'?\d{2,4}", r"(?i)Q[1-4]\s*FY\s*'?\d{2,4}", r"(?i)H[12]\s*FY\s*'?\d{2,4}",
    r"(?i)(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{4}", r"\d{4}-\d{2,4}",
]
METRIC_PATTERNS = [
    ("amount_crore", r"(?i)(?:INR|Rs\.?|₹)\s*([\d,]+\.?\d*)\s*(?:crore|crores|cr)"),
    ("percentage", r"(?i)(\d+\.?\d*)\s*(?:%|percent|basis points|bps)"),
    ("count", r"(?i)([\d,]+)\s*(?:rooms|keys|properties|hotels)"),
]


def time_refs(text: Column) -> Column:
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in TIME_PATTERNS])
    return F.array_distinct(F.transform(found, lambda x: F.trim(x)))


def match_spans(text: Column, pattern: str) -> Column:
    """``array<struct<pos,hit>>`` of every match: positions rebuilt from the gaps between."""
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("h"), F.split(text, pattern, -1).alias("g"))

    def place(x: Column) -> Column:
        before = lambda i: (
            F.aggregate(F.slice(x["g"], F.lit(1), i + 1), F.lit(0), lambda a, g: a + F.length(g))
            + F.aggregate(F.slice(x["h"], F.lit(1), i), F.lit(0), lambda a, h: a + F.length(h)))
        return F.transform(x["h"], lambda h, i: F.struct(before(i).alias("pos"), h.alias("hit")))

    return let(parts, place)


def numeric_metrics(df: DataFrame, text: str, keep: Sequence[str], around: int = 40) -> DataFrame:
    """(type, value, position, context) of every number with a unit, context ±40 chars."""
    def cells(kind: str, pattern: str) -> Column:
        return F.transform(match_spans(F.col(text), pattern), lambda m: F.struct(
            F.lit(kind).alias("type"), F.replace(F.regexp_extract(m["hit"], pattern, 1), F.lit(","), F.lit("")).alias("value"),
            m["pos"].alias("position"), F.length(m["hit"]).alias("n")))

    parts = [cells(kind, pattern) for kind, pattern in METRIC_PATTERNS]
    one = df.select(*keep, text, F.inline(F.concat(*parts)))
    start = F.greatest(F.col("position") - around, F.lit(0))
    end = F.least(F.length(text), F.col("position") + F.col("n") + around)
    return one.withColumn("context", F.trim(F.substring(F.col(text), start + 1, end - start))).select(*keep, "type", "value", "position", "context")


def group_scores(text: Column, groups: Mapping[str, Sequence[str]], extra: Mapping[str, Sequence[str]] | None = None, match: str = "substring", count=None) -> Column:
    """``array<struct<score,name>>`` of the groups that hit, best first, list order on ties."""
    number = word_hits if match != "substring" else lambda t, ws: hits(t, ws, count)
    extra = extra or {}
    cells = [
        F.struct((-(number(text, ws) + number(text, extra.get(g, [])))).alias("neg"), F.lit(i).alias("ord"), F.lit(g).alias("name"))
        for i, (g, ws) in enumerate(groups.items())
    ]
    return F.transform(F.array_sort(F.filter(F.array(*cells), lambda s: s["neg"] < 0)), lambda s: F.struct((-s["neg"]).alias("score"), s["name"].alias("name")))


def is_high_signal(text: Column, skip: Sequence[str], signal: Sequence[str], max_skip: int = 3) -> Column:
    return (hits(text, skip) < max_skip) & any_hit(text, signal)


def heading_section(text: Column, sections: Sequence[str]) -> Column:
    """First listed section that opens a line of the page."""
    low = F.lower(text)
    return F.coalesce(*[F.when(F.rlike(low, F.lit(rf"(^|\n)\s*\Q{s}\E")), F.lit(s)) for s in sections])


def detect(text: Column, aliases: Mapping[str, Sequence[str]], mode: str = "many", count=None) -> Column:
    """Codes whose alias occurs in the text: all of them, or the first listed."""
    found = [F.when(any_hit(text, ws, count), F.lit(code)) for code, ws in aliases.items()]
    return F.coalesce(*found) if mode == "first" else F.filter(F.array(*found), lambda c: c.isNotNull())
