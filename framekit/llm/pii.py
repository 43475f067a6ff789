"""Personal data: fixed forms, then bootstrapped contextual extraction.

Base spans come from fixed forms: e-mail and IP addresses, card numbers with a right check digit, and phone numbers. They are the seeds of a
bootstrap that looks for identifiers of other forms (written-out addresses, ticket or account numbers):

1. The words before a seed make a lexical pattern: the two words before it and, if the last one ends like a label (``:``, ``=``, ``#``), that
   word alone. Patterns with at least ``LEAST_SEEDS`` different seeds are kept.
2. A second pass over all texts finds each place where such a pattern stands, what follows it there, and how often the pattern stands before
   ordinary words. What looks like an identifier and overlaps no base span is a candidate: an address in words (``jane at mail dot com``, up to
   eight dots on each side), groups of digits and capitals on one line (``(826) 555-4081``, up to ``LONGEST`` letters and digits), or one word.
   The longest that is free counts.
3. Patterns and what they met (seeds and candidates) are a bipartite graph. In each of ``ROUNDS`` rounds a pattern's score is the mean score
   of what it met (ordinary words count 0, seeds 1), and a candidate's score is one minus the product of ``1 - score`` over its patterns.
4. Candidates whose score reaches ``ACCEPTED`` beside a pattern that reaches it too are added as spans of the kind of that pattern's seeds.

Both passes run over whole texts. Patterns are looked up in memory if they are few (``common.BROADCAST_ROWS``); otherwise every place is
emitted and joined with them. Spans come back to their documents by a join on the id and a digest of the text.

Spans are (kind, start, end) in code points, end exclusive. A null text is empty and has no spans. Rows, repeated ones included, and other
columns stay; a column ``spans``, ``base`` or ``digest`` of the input is replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framekit.llm.common import BROADCAST_ROWS, long_texts, slices, unused
from framekit.session import cut

# Fixed forms.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

LEAST_SEEDS = 3
ROUNDS = 3
ACCEPTED = 0.6
#: What may be an identifier: a word of these signs with a digit or an at sign, at least so long without the marks around it.
IDENTIFIER = re.compile(r"(?=[^@0-9]*[@0-9])[A-Za-z0-9@._%+:/()#-]{5,}")
MARKS = ".,;:!?)('\"<>"
#: An address written out: bare ``at`` and ``dot`` between blanks, or in brackets. It stays on one line.
_AT, _DOT = (rf"(?:[^\S\n]*[(\[{{]{word}[)\]}}][^\S\n]*|[^\S\n]+{word}[^\S\n]+)" for word in ("at", "dot"))
WRITTEN = re.compile(
    rf"[A-Za-z0-9._%+-]++(?:{_DOT}[A-Za-z0-9._%+-]++){{0,8}}{_AT}[A-Za-z0-9-]++(?:(?:{_DOT}|\.)[A-Za-z0-9-]++){{1,8}}", re.IGNORECASE,
)
SPELT = re.compile(r"(?:^|[(\[{])(?:at|dot)(?:$|[)\]}])", re.IGNORECASE)
#: One group of an identifier in groups: digits with capitals and separators, or a short code in capitals before digits.
PART = re.compile(r"[A-Z0-9()+./#-]*[0-9][A-Z0-9()+./#-]*|[A-Z]{1,4}")
#: Letters and digits that groups hold together at most, as the longest bank account numbers do, and digits at least.
LONGEST, LEAST_DIGITS = 34, 4
STOPS = ".,;:!?'\">"
LABEL_ENDS = (":", "=", "#")
#: Counts that a task holds before it hands them on; it changes speed only.
HELD = 200_000
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, at sign and domain; the local part is the whole run before the sign, so it is read backwards once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed forms, by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            for m in IP.finditer(text):
                if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m.group().split("."))):
                    out.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= sum(c in "0123456789" for c in m.group()) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return out


def contexts(before: str) -> list[str]:
    """Patterns of the text before a place: two words, or one that ends like a label."""
    last = before.lower().split()[-2:]
    out = [" ".join(last)] if len(last) == 2 else []
    if last and last[-1].endswith(LABEL_ENDS):
        out.append(last[-1])
    return out


def _seeds(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, str, str]]:
    """(pattern, kind, seed) of each base span; the words before it are read from the 200 characters before, which hold two words of prose."""
    return [(p, kind, text[start:end]) for kind, start, end in spans for p in contexts(_lead(text, start))]


def _lead(text: str, start: int) -> str:
    """Text before ``start`` that holds at least two whole words, or all of it."""
    width = 64
    while True:
        part = text[max(0, start - width) : start]
        if width >= start or len(part.split()) > 2:
            return part
        width *= 4


def find_base(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``digest`` of the text, ``base`` spans and ``seeds`` (pattern, kind, seed); the text itself stays behind."""
    kept = [f for f in docs.schema.fields if f.name != text_col and f.name.lower() not in ("base", "seeds", "digest", "spans")]
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    seeds = pa.list_(pa.struct([("pattern", pa.string()), ("kind", pa.string()), ("seed", pa.string())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            found = [base_spans(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(f.name) for f in kept),
                    pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in found], spans),
                    pa.array([[dict(zip(("pattern", "kind", "seed"), s, strict=True)) for s in _seeds(t, x)] for t, x in zip(texts, found, strict=True)], seeds),
                    batch.column("digest"),
                ],
                names=[*(f.name for f in kept), "base", "seeds", "digest"],
            )

    shape = T.StructType([
        *kept, T.StructField("base", T._parse_datatype_string(SPANS)),
        T.StructField("seeds", T._parse_datatype_string("array<struct<pattern:string,kind:string,seed:string>>")), T.StructField("digest", T.StringType()),
    ])
    given = long_texts(docs).select(*(f.name for f in kept), text_col, text_digest(F.col(text_col)).alias("digest"))
    return given.mapInArrow(run, shape)


def text_digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def may_begin(words: list[str], at: int) -> bool:
    """Whether an identifier may begin at a word; it says no only where ``forms`` finds none."""
    if IDENTIFIER.fullmatch(words[at].strip(MARKS)):
        return True
    after = words[at + 1] if at + 1 < len(words) else ""
    if SPELT.search(words[at]) or SPELT.search(after):
        return True
    return len(words[at]) <= 2 * LONGEST and PART.fullmatch(words[at]) is not None and after[:1] in "0123456789()+./#-ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def forms(text: str, where: list[tuple[int, int]], at: int) -> Iterator[tuple[int, int]]:
    """Spans from a word on that look like an identifier: an address in words, groups from the longest on, the word itself."""
    start, end = where[at]
    word = text[start:end]
    core = word.strip(MARKS)
    inner = start + word.index(core)
    written = WRITTEN.match(text, inner)
    if written:
        yield written.span()
    yield from reversed(groups(text, where, at))
    if IDENTIFIER.fullmatch(core):
        yield inner, inner + len(core)


def groups(text: str, where: list[tuple[int, int]], at: int) -> list[tuple[int, int]]:
    """Spans of two or more groups from a word on, shortest first; a mark after a group or the line's end ends them."""
    out: list[tuple[int, int]] = []
    signs = digits = 0
    for i in range(at, len(where)):
        start, end = where[i]
        if end - start > 2 * LONGEST or (i > at and "\n" in text[where[i - 1][1] : start]):
            break
        part = text[start:end].rstrip(STOPS)
        signs += sum(c.isalnum() for c in part)
        if not PART.fullmatch(part) or signs > LONGEST:
            break
        own = sum(c in "0123456789" for c in part)
        if i > at and own and len(part) == 1:
            break
        digits += own
        if i > at and own and digits >= LEAST_DIGITS:
            out.append(_balanced(text, where[at][0], start + len(part)))
        if len(part) < end - start:
            break
    return out


def _balanced(text: str, start: int, end: int) -> tuple[int, int]:
    """A span without a closing bracket at its end, or an opening one at its start, that has no partner inside."""
    opened, closed = text.count("(", start, end), text.count(")", start, end)
    while closed > opened and text[end - 1] == ")":
        end, closed = end - 1, closed - 1
    while opened > closed and text[start] == "(":
        start, opened = start + 1, opened - 1
    return start, end


def places(docs: DataFrame, id_col: str, text_col: str, wanted: frozenset[str] | None) -> DataFrame:
    """Where patterns stand: ``pattern, id, digest, candidate, start, end, n``.

    A row with a candidate is one place. A row without counts ``n`` places before ordinary words or base spans. With ``wanted`` only
    these patterns are looked for.
    """
    lasts = None if wanted is None else frozenset(p.rsplit(" ", 1)[-1] for p in wanted)
    names = ("pattern", "id", "digest", "candidate", "start", "end", "n")
    kinds = T.StructType([
        T.StructField("pattern", T.StringType()), T.StructField("id", docs.schema[id_col].dataType), T.StructField("digest", T.StringType()),
        T.StructField("candidate", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("n", T.LongType()),
    ])

    def hits(text: str) -> list[tuple[int, str]]:
        """(number of the word that follows, pattern)"""
        low = text.lower().split()
        out = []
        for i, word in enumerate(low):
            if lasts is None or word in lasts:
                if i and (wanted is None or f"{low[i - 1]} {word}" in wanted):
                    out.append((i + 1, f"{low[i - 1]} {word}"))
                if word.endswith(LABEL_ENDS) and (wanted is None or word in wanted):
                    out.append((i + 1, word))
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in slices(batches):
            id_type = batch.schema.field(0).type
            rows: list[tuple] = []
            for doc, text, digest in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = hits(text) if text else ()
                if not found:
                    continue
                words, taken = text.split(), None
                ahead = {at for at, _ in found if at < len(words) and may_begin(words, at)}
                if ahead:
                    where = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
                    taken = base_spans(text)
                    aligned = len(where) == len(words)
                for at, pattern in found:
                    if at in ahead and aligned:
                        free = (s for s in forms(text, where, at) if not any(a < s[1] and s[0] < b for _, a, b in taken))
                        start, end = next(free, (0, 0))
                        if end:
                            rows.append((pattern, doc, digest, text[start:end], start, end, 1))
                            continue
                    held[pattern] += 1
            if len(held) > HELD:
                rows += [(p, None, None, None, None, None, n) for p, n in held.items()]
                held.clear()
            if rows:
                yield pa.RecordBatch.from_arrays(_columns(rows, id_type), names=names)
        if held:
            rest = [(p, None, None, None, None, None, n) for p, n in held.items()]
            yield pa.RecordBatch.from_arrays(_columns(rest, id_type), names=names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_digest(F.col(text_col)).alias("digest")).mapInArrow(run, kinds)


def _columns(rows: list[tuple], id_type: pa.DataType) -> list[pa.Array]:
    types = (pa.string(), id_type, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    return [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), types, strict=True)]


def score_graph(seeds: DataFrame, met: DataFrame) -> DataFrame:
    """Scores of candidates beside patterns: ``pattern, candidate, kind, pattern_score, score``.

    ``seeds`` holds ``pattern, kind, seeds`` (places before seeds); ``met`` holds ``pattern, candidate, n`` with null candidates for all
    other places, those before seeds included.
    """
    total = met.groupBy("pattern").agg(F.sum("n").alias("total"))
    known = seeds.groupBy("pattern").agg(F.sum("seeds").alias("seeds"), F.max_by("kind", F.struct("seeds", "kind")).alias("kind"))
    patterns = known.join(total, "pattern")
    edges = met.filter(F.col("candidate").isNotNull()).groupBy("pattern", "candidate").agg(F.sum("n").alias("n"))
    gained = patterns.select("pattern", F.lit(0.0).alias("gained"))
    for i in range(ROUNDS):
        scored = patterns.join(gained, "pattern", "left").withColumn(
            "pattern_score", F.least(F.lit(1.0), (F.col("seeds") + F.coalesce("gained", F.lit(0.0))) / F.greatest("total", "seeds")),
        ).select("pattern", "kind", "pattern_score")
        beside = edges.join(scored, "pattern")
        doubt = F.when(F.max("pattern_score") >= 1, F.lit(1.0)).otherwise(1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-12), 1 - F.col("pattern_score"))))))
        candidates = beside.groupBy("candidate").agg(doubt.alias("score"))
        result = beside.join(candidates, "candidate")
        if i + 1 < ROUNDS:
            gained = cut(result.groupBy("pattern").agg(F.sum(F.col("n") * F.col("score")).alias("gained")), "gained")
    return result.select("pattern", "candidate", "kind", "pattern_score", "score")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with ``digest``, ``base`` and all ``spans``, both sorted by kind as listed, then start."""
    based = cut(find_base(docs, text_col), "base")
    seeds = based.select(F.explode("seeds").alias("s")).select("s.*").groupBy("pattern", "kind").agg(
        F.countDistinct("seed").alias("different"), F.count("*").alias("seeds"),
    )
    enough = seeds.withColumn("of_pattern", F.sum("different").over(Window.partitionBy("pattern"))).filter(F.col("of_pattern") >= LEAST_SEEDS)
    patterns = cut(enough.select("pattern", "kind", "seeds"), "patterns")
    few = patterns.select("pattern").distinct().limit(BROADCAST_ROWS + 1).collect()
    wanted = frozenset(r.pattern for r in few) if len(few) <= BROADCAST_ROWS else None
    found = places(docs, id_col, text_col, wanted)
    if wanted is None:
        found = found.join(patterns.select("pattern").distinct(), "pattern", "left_semi")
    met = cut(found, "places")
    accepted = score_graph(patterns, met.select("pattern", "candidate", "n")).filter(
        (F.col("pattern_score") >= ACCEPTED) & (F.col("score") >= ACCEPTED),
    ).select("pattern", "candidate", "kind")
    added = met.filter(F.col("candidate").isNotNull()).join(accepted, ["pattern", "candidate"]).groupBy("id", "digest").agg(
        F.collect_set(F.struct(F.col("kind"), F.col("start"), F.col("end"))).alias("__added"),
    )
    order = {kind: i for i, kind in enumerate(KINDS)}
    number = F.create_map(*(F.lit(x) for pair in order.items() for x in pair))
    joined = based.drop("seeds").join(added, based[id_col].eqNullSafe(added["id"]) & (based["digest"] == added["digest"]), "left").select(
        *(based[c] for c in based.columns if c != "seeds"), added["__added"],
    )
    numbered = F.transform(
        F.array_union("base", F.coalesce("__added", F.array().cast(SPANS))),
        lambda s: F.struct(number[s["kind"]].alias("place"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    spans = F.transform(F.sort_array(numbered), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return joined.withColumn("spans", spans).drop("__added")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each span in the text replaced by ``<KIND>``; of overlapping spans the first, then the longest, counts."""
    own = unused(docs, "spans")
    spans = find(docs.select(id_col, text_col), id_col, text_col).select(F.col(id_col).alias("__id"), F.col("digest").alias("__digest"), F.col("spans").alias(own)).filter(
        F.size(own) > 0,
    ).dropDuplicates(["__id", "__digest"])
    spans = cut(spans, "spans")
    size = spans.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size(own)), F.lit(0)).alias("spans")).first()
    if size["rows"] <= BROADCAST_ROWS and size["spans"] <= 4 * BROADCAST_ROWS:
        spans = F.broadcast(spans)
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text, found in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                parts, done = [], 0
                for s in sorted(found or (), key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= done:
                        parts += [text[done : s["start"]], f"<{s['kind'].upper()}>"]
                        done = s["end"]
                out.append(text if not parts else "".join([*parts, text[done:]]))
            columns = [pa.array(out, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    with_spans = docs.join(spans, docs[id_col].eqNullSafe(spans["__id"]) & (text_digest(docs[text_col]) == spans["__digest"]), "left")
    return with_spans.select(*(docs[c] for c in docs.columns), spans[own]).mapInArrow(run, docs.schema)
