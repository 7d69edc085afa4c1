"""Personal data: base rules by pattern, more spans by bootstrapped contextual extraction.

Spans that the base rules find are seeds. Around each, lexical patterns of its kind are read: the
word before it or the characters glued to its front, its form (digits and letters as classes, in
full and with runs merged), and word and form together. Patterns and the identifier-like strings
they hold for are the two sides of a graph. In each round patterns are scored by the share of
their places that accepted strings fill; those that are reliable accept further strings, and from
these the next round induces new patterns. What reliable patterns find, and the base rules
don't, is added.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, record, slices, texts_of, tidy

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# A match can only begin where a run of digits begins, and gains nothing by giving digits back.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping: a local part is the whole run before its sign, in linear time."""
    out, end = [], 0
    for m in _DOMAIN.finditer(text):
        low = max(end, text.rfind("@", 0, m.start()) + 1)
        local = text[low : m.start()]
        size = len(local) - len(local.rstrip(_LOCAL))
        if size:
            out.append((m.start() - size, m.end()))
            end = m.end()
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (1 + n % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans (code points, end exclusive) of each kind by the base rules; failing matches are dropped."""
    out = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = _emails(text)
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.findall(m[0])) <= 15]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out["card"].append(m.span())
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
                out["ip"].append(m.span())
    return out


#: A token's identifier: a stretch of these characters with a letter; it must hold a digit or a sign.
_CORE = re.compile(r"[^\W_][\w.%+@-]*")
_MARKED = re.compile(r"[0-9@]")
_INK = re.compile(r"\S*")
#: Digit groups that blanks, brackets, points, strokes and hyphens part.
_RUN = re.compile(r"(?<![\w@])\+?\(?[0-9]++(?:[ ()./-]{1,2}[0-9]++)*(?![\w@])")
_GROUP = re.compile(r"[+(]*[0-9]+")
_DIGIT_RUNS, _LETTER_RUNS = re.compile(r"[0-9]+"), re.compile(r"[^\W\d_]+")
#: Characters of the shortest identifier, of the longest form, and of the longest context.
LEAST, LONGEST = 4, 40


def cores_of(token: str) -> list[tuple[int, int]]:
    """Where the identifier-like parts of a token are: four characters or more, a letter or a sign among them."""
    out = []
    for m in _CORE.finditer(token):
        core = m[0].rstrip(".%+@-_")
        if len(core) >= LEAST and _MARKED.search(core) and not _RUN.fullmatch(core):
            out.append((m.start(), m.start() + len(core)))
    return out


def patterns_before(text: str, start: int) -> list[str]:
    """Lexical patterns of what begins at `start`: "w:" and the preceding word, "g:" and glued characters."""
    far = max(0, start - LONGEST - 1)
    low = max(far, max(text.rfind(c, far, start) for c in " \n\t\r") + 1)
    glue = text[low:start].lower()
    if glue:
        return ["g:" + glue] if len(glue) <= LONGEST and any(map(str.isalpha, glue)) else []
    before = text[max(0, low - 60) : low].split()
    return ["w:" + before[-1].lower()] if before else []


def forms_of(identifier: str) -> list[str]:
    """Its form with every digit as 9 and runs of letters as a ("f:"), and with runs of digits merged too ("c:")."""
    if len(identifier) > LONGEST:
        return []
    plain = _LETTER_RUNS.sub("a", identifier)
    return ["f:" + _DIGITS.sub("9", plain), "c:" + _DIGIT_RUNS.sub("9", plain)]


def patterns_at(text: str, start: int, end: int) -> list[str]:
    """All patterns of an identifier: context, forms, and context with the merged form ("x:")."""
    before, forms = patterns_before(text, start), forms_of(text[start:end])
    return [*before, *forms, *(f"x:{b}|{forms[1]}" for b in before if forms)]


@dataclass(frozen=True)
class ContextModel:
    """kind of each reliable pattern: contexts ("w:", "g:"), and forms ("f:", "c:", "x:")."""

    kinds: dict[str, str]
    forms: dict[str, str] = field(default_factory=dict)

    def by_form(self, text: str, start: int, end: int) -> str | None:
        """Kind of an identifier by its form: with its context first, then in full, then merged."""
        found = {p[0]: kind for p in patterns_at(text, start, end) if (kind := self.forms.get(p))} if self.forms else {}
        return next((found[c] for c in "xfc" if c in found), None)

    def by_context(self, text: str, start: int) -> str | None:
        return next((kind for p in patterns_before(text, start) if (kind := self.kinds.get(p))), None)


def _marked_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Stretches without white space that hold a digit or a sign."""
    at = 0
    while m := _MARKED.search(text, at):
        start, end = m.start(), _INK.match(text, m.start()).end()
        while start > at and not text[start - 1].isspace():
            start -= 1
        yield start, end
        at = end


def candidates(text: str) -> list[tuple[int, int]]:
    """Identifier-like places: cores of tokens, and runs of digit groups."""
    if not _MARKED.search(text):
        return []
    out = [(start + a, start + b) for start, end in _marked_tokens(text) for a, b in cores_of(text[start:end])]
    return sorted(out + [m.span() for m in _RUN.finditer(text) if m.end() - m.start() >= LEAST])


class _Taken:
    """The base spans of a text, to be asked about overlaps."""

    def __init__(self, base: dict[str, list[tuple[int, int]]]):
        spans = sorted(s for found in base.values() for s in found)
        self.starts, self.ends = [a for a, _ in spans], [0, *accumulate((b for _, b in spans), max)]

    def touches(self, start: int, end: int) -> bool:
        return self.ends[bisect_left(self.starts, end)] > start


def _parts_of_run(text: str, start: int, end: int, longest: int = 6) -> list[tuple[int, int]]:
    """A run of digit groups and its parts between blanks, of up to `longest` groups; leftmost and longest first."""
    groups = [(start + m.start(), start + m.end()) for m in _GROUP.finditer(text[start:end])]
    opens = [0, *(i for i in range(1, len(groups)) if " " in text[groups[i - 1][1] : groups[i][0]]), len(groups)]
    out = []
    for n, i in enumerate(opens[:-1]):
        for j in reversed(opens[n + 1 : n + 1 + longest]):
            out.append((groups[i][0], groups[j - 1][1]))
    return out if out[0] == (start, end) else [(start, end), *out]


def more_spans(text: str, base: dict[str, list[tuple[int, int]]], model: ContextModel) -> list[tuple[str, int, int]]:
    """Identifiers that reliable patterns hold for and that touch no base span, without overlaps."""
    if not model.kinds and not model.forms or not _MARKED.search(text):
        return []
    taken, out, upto = _Taken(base), [], 0
    for start, end in candidates(text):
        before = len(out)
        for a, b in _parts_of_run(text, start, end) if _RUN.fullmatch(text, start, end) else [(start, end)]:
            if a >= upto and b - a >= LEAST and not taken.touches(a, b) and (kind := model.by_form(text, a, b)):
                out.append((kind, a, b))
                upto = b
        # Without a known form in it, the whole is what its context says.
        if len(out) == before and start >= upto and not taken.touches(start, end) and (kind := model.by_context(text, start)):
            out.append((kind, start, end))
            upto = end
    return out


def _edges(docs: DataFrame) -> DataFrame:
    """pattern, instance, kind, n: identifier-like strings and the patterns at their places; kind is a seed's, else null."""
    schema = pa.schema([("pattern", pa.string()), ("instance", pa.int64()), ("kind", pa.string()), ("n", pa.int64())])

    def find(batches):
        for batch in slices(batches, 2048):
            seen: Counter = Counter()
            for text in texts_of(batch.column(0)):
                base = base_spans(text)
                taken = _Taken(base)
                places = [(k, a, b) for k, spans in base.items() for a, b in spans]
                places += [(None, a, b) for a, b in candidates(text) if not taken.touches(a, b)]
                for kind, a, b in places:
                    name = xxhash.xxh3_64_intdigest(text[a:b].encode("utf-8", "surrogatepass")) >> 1
                    seen.update((p, name, kind) for p in patterns_at(text, a, b))
            if seen:
                yield record(schema, [*zip(*seen, strict=True), list(seen.values())])

    return docs.mapInArrow(tidy(find), "pattern string, instance long, kind string, n long")


def pattern_places(edges: DataFrame, support: int) -> DataFrame:
    """pattern, instance, n, open, total: the places of each string, whether one of them is no seed's, and all of the pattern's.

    Only of patterns with `support` different strings: others can't become reliable, whatever is accepted.
    """
    places = edges.groupBy("pattern", "instance").agg(F.sum("n").alias("n"), F.bool_or(F.col("kind").isNull()).alias("open"))
    total = places.groupBy("pattern").agg(F.sum("n").alias("total"), F.count("*").alias("strings")).where(F.col("strings") >= support)
    return places.join(total.select("pattern", "total"), "pattern")


def score_patterns(places: DataFrame, accepted: DataFrame) -> DataFrame:
    """pattern, kind, r, strings: share of a pattern's places that accepted strings of a kind fill, each by its score, and how many strings."""
    held = places.join(accepted, "instance").groupBy("pattern", "kind")
    return held.agg((F.sum(F.col("n") * F.col("ri")) / F.max("total")).alias("r"), F.count("*").alias("strings"))


def learn_contexts(docs: DataFrame, rounds: int = 3, reliable: float = 0.8, support: int = 5, at_once: int = 200_000) -> ContextModel:
    """Score the pattern-instance graph in rounds and keep the patterns that end reliable.

    Round by round: a pattern's reliability is the mean, over all identifier-like strings at its
    places, of their scores for one kind; a pattern with `support` different accepted strings, at
    any size of the table, and a reliability of `reliable` or more accepts the other strings at its
    places with that score; patterns around these are induced and scored in the next round.
    Seeds score one. The graph is a table; the driver fetches the final patterns `at_once` at a time.
    """
    text = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    edges = materialize(_edges(text).groupBy("pattern", "instance", "kind").agg(F.sum("n").alias("n")), "pii-edges", narrow=True)
    seeds = materialize(edges.where("kind IS NOT NULL").groupBy("instance", "kind").agg(F.lit(1.0).alias("ri")), "pii-seeds", narrow=True)
    places = materialize(pattern_places(edges, support), "pii-places", narrow=True)
    accepted = seeds
    for turn in range(rounds):
        scores = score_patterns(places, accepted)
        good = materialize(scores.where((F.col("strings") >= support) & (F.col("r") >= reliable)).select("pattern", "kind", "r"), "pii-scores", narrow=True)
        if turn == rounds - 1:
            break
        others = places.where("open").select("pattern", "instance").join(good, "pattern").groupBy("instance", "kind").agg(F.max("r").alias("ri"))
        accepted = materialize(seeds.unionByName(others.join(seeds, "instance", "left_anti").select("instance", "kind", "ri")), "pii-accepted", narrow=True)
    best = good.groupBy("pattern").agg(F.max(F.struct("r", "kind")).alias("best")).select("pattern", F.col("best.kind").alias("kind"))
    passes, found = max(1, -(-best.count() // at_once)), {}
    for k in range(passes):
        found.update(best.where(F.pmod(F.xxhash64("pattern"), F.lit(passes)) == k).collect())
    context = lambda p: p[:2] in ("w:", "g:")
    return ContextModel({p: k for p, k in found.items() if context(p)}, {p: k for p, k in found.items() if not context(p)})


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def all_spans(text: str, model: ContextModel) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """Base spans by kind, and all spans by kind and start."""
    base = base_spans(text)
    spans = [(k, a, b) for k in KINDS for a, b in base[k]]
    found = more_spans(text, base, model)
    if found:
        spans = sorted(spans + found, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return base, spans


def find_pii(docs: DataFrame) -> DataFrame:
    """Per document doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all).

    Null text counts as empty: no spans, the digest of the empty string. Null and repeated ids
    keep a row each; an empty table gives no rows. Only doc_id and text are read.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn_contexts(docs))
    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string())])

    def find(batches):
        for batch in slices(batches):
            out = [[] for _ in range(6)]
            for text in texts_of(batch.column(1)):
                base, spans = all_spans(text, model.value)
                for column, k in zip(out, KINDS, strict=False):
                    column.append(len(base[k]))
                out[4].append(hashlib.sha256(_joined([(k, a, b) for k in KINDS for a, b in base[k]]).encode()).hexdigest())
                out[5].append(_joined(spans))
            yield record(schema, [batch.column(0), *out])

    kinds = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(find), f"doc_id long, {kinds}, base_sha256 string, spans string")


def redact(text: str, model: ContextModel) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans merge."""
    _, spans = all_spans(text, model)
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact_column(model: ContextModel, text, spark):
    """The redacted text as a column; null stays null."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: t if t is None else redact(t, shared.value))

    return clean(text)
