"""Operator 8: personal identifiers by bootstrapped contextual extraction.

Candidates are the values of a text, parted by white space and separators, that hold a digit or an @, and what stands behind a secret's name. Seeds are those that a validator accepts (mail address,
dotted IP address, phone number, social security number, card number with a right check digit, key with a known prefix,
value after a secret's name); plain short numbers, decimals, times and dates are known not to be identifiers. Digit groups
a space apart that make one number are one candidate. Each candidate stands in lexical patterns: its shape,
its tail, and the words before or behind it with its rough shape. Pattern and instance score each other in turn: a
pattern by the confidence of its distinct instances against what is known to be none and, weakly, what is unknown; an
instance by the patterns that are good enough. After a few rounds the confident patterns' instances, seen or not in the seeds,
are reported where they occur. Words without a digit or @ are admitted at the end, where the two words before are as
confident a context whatever the shape, each distinct word counted against it. One pass over the text leaves only the candidates; the graph is small and is written
to the shared folder each round.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmesh.llm.common import Scratch, col, id_types, slices

ROUNDS = 4
LEAST_PATTERN = 0.6
LEAST_SUPPORT = 3
LEAST_INSTANCE = 0.6
UNKNOWN_WEIGHT = 0.05

_MARK = re.compile(r"[0-9@]")
_EDGE_L, _EDGE_R = "\"'`|<>[]{};,:=.!?*&%$#)", "\"'`|<>[]{};,:=.!?*&%$#("
_MAIL = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}")
_IP = re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)")
_PHONE = re.compile(r"\+\d{1,3} ?\(?\d{2,4}\)?[ -]\d{3}[ -]\d{3,4}")
_KEY = re.compile(r"AKIA[0-9A-Z]{16}")
_SECRET = re.compile(r"(?i)(token|secret|password|passwd|api[_-]?key|key)[\"']?\s*[:=]\s*[\"']?$")
#: A secret without a digit: a name that leaves little doubt ("key" does), and 12 characters or more.
_CUE = re.compile(r"(?i)(?:token|secret|password|passwd|pwd|api[_-]?key)[\"']?\s*[:=]\s*[\"']?(?=[^\s\"'<>&;,]{12})")
_LOCAL_PHONE = re.compile(r"(?:\+?1[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}")
_SSN = re.compile(r"(?!000|666|9)\d{3}([ -])(?!00)\d\d\1(?!0000)\d{4}")
_DAY, _MONTH = r"(?:0?[1-9]|[12]\d|3[01])", r"(?:0?[1-9]|1[0-2])"
#: Counts, decimals, thousands, times, dates, fractions, short ranges and ranges of years, ordinals.
_NUMBER = re.compile(
    r"#?\d{1,6}[.%)]?|\d{1,6}[.,]\d{1,4}%?|\d{1,3}(?:,\d{3})+(?:\.\d{1,4})?|\d{1,2}(?:[. ]\d{3}){1,2}(?:,\d{1,4})?|\d{1,2}:\d{2}(?:[:.]\d{2})?"
    rf"|(?:1\d|20)\d\d([./-]){_MONTH}\1{_DAY}|{_DAY}([./-]){_MONTH}\2(?:(?:1\d|20)\d\d|\d\d)|{_MONTH}([./-]){_DAY}\3(?:(?:1\d|20)\d\d|\d\d)"
    r"|\d{1,4}/\d{1,4}|\d{1,2}-\d{1,2}|(?:1\d|20)\d\d-(?:\d\d|(?:1\d|20)\d\d)|\d{1,2}(?:st|nd|rd|th)"
)
_GROUP = re.compile(r"\+?(?:\(\d+\)|\d+)(?:[-./]?(?:\(\d+\)|\d+))*")
_NEXT = re.compile(r"[ \u00a0]((?:\(\d+\)|\d+)(?:[-./]?(?:\(\d+\)|\d+))*)(?=[^\w@]*(?:\s|$))")
#: A value between separators; base64 keeps its padding.
_PIECE = re.compile(r"(?P<padded>(?:(?:[\w+/-]{4}){2,}(?:[\w+/-]{2}==|[\w+/-]{3}=)|[\w+/-]{16,}={1,2})(?!=|\w|[\"']\w))|[^=&;<>|\"\[\]{}]+", re.A)
_INNER = re.compile(r"[^:,()]+")
_COLONS = re.compile(r"(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}|\d{4}-\d\d-\d\dT[\d:.]+(?:Z|[+-]\d\d:?\d\d)?")
_WORD = re.compile(r"\w+|[=:]")
_CARD_GROUPS = re.compile(r"\d{4}([ -])\d{4}\1\d{4}\1\d{1,4}(?:\1\d{1,3})?|\d{4}([ -])\d{6}\2\d{4,5}")
_AFTER = re.compile(r"\W*(\w+)")
_YEAR = re.compile(r"(?:1\d|20)\d\d")
_PART = re.compile(r"[0-9a-f]{16,}|[0-9A-F]{16,}|[A-Z0-9]{16,}|\d+|[^\W\d_]+|.", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def shape(value: str, rough: bool = False) -> str:
    """What a value looks like: runs of digits (by length where 4 or more), of letters, long codes; all else as it is."""
    out = []
    for p in _PART.findall(value):
        if p.isdigit():
            out.append("9" if rough else "9" * len(p) if len(p) < 2 else f"9<{len(p)}>" if len(p) > 3 else "9+")
        elif len(p) >= 16 and p.isascii() and p.isalnum() and not p.isalpha():
            out.append("h" if rough else f"h<{len(p)}>")
        elif p.isalpha():
            out.append("a")
        else:
            out.append(p)
    s = "".join(out)
    return re.sub(r"9\+?(?:\.9\+?)+", lambda m: ".".join("9" for _ in m.group().split(".")), s)


def seed_type(value: str, before: str) -> str | None:
    """The type of a value that a validator accepts, '' for what is known to be no identifier, None for the rest."""
    if _MAIL.fullmatch(value):
        return "email"
    if _IP.fullmatch(value):
        return "ip"
    if _PHONE.fullmatch(value) or _LOCAL_PHONE.fullmatch(value):
        return "phone"
    if _SSN.fullmatch(value):
        return "ssn"
    if _KEY.fullmatch(value):
        return "key"
    digits = re.sub(r"[ -]", "", value)
    if digits.isascii() and digits.isdigit() and 13 <= len(digits) <= 19 and luhn(digits) and len(set(digits)) > 1:
        return "card"
    if len(value) >= 12 and _SECRET.search(before):
        return "secret"
    return "" if _NUMBER.fullmatch(value) else None


def joins(value: str) -> bool:
    """Whether digit groups with spaces between them are one value: an accepted number, a number to dial, or groups of at most 6 digits."""
    if _CARD_GROUPS.fullmatch(value) or _PHONE.fullmatch(value) or _LOCAL_PHONE.fullmatch(value) or _SSN.fullmatch(value):
        return True
    parts = value.replace("\u00a0", " ").split(" ")
    sizes = [len(g) for g in re.findall(r"\d+", value)]
    if any(_IP.fullmatch(p) or len(p) > 5 and _NUMBER.fullmatch(p) for p in parts):
        return False
    if value[0] in "+(":
        return 7 <= sum(sizes) <= 15
    if seed_type(value, "") == "card":
        return max(sizes) <= 8
    if max(sizes) > 6 or not 7 <= sum(sizes) <= 19:
        return False
    return len(sizes) > 2 or min(sizes) > 2 and not all(map(_YEAR.fullmatch, parts))


def groups(text: str, a: int, z: int) -> list[tuple[int, int]]:
    """Cuts a token and the digit groups that follow it, a space apart, into values: each the longest that is accepted, or else that joins."""
    ends, at = [z], z
    while text[at - 1] not in ".,;:!?" and (m := _NEXT.match(text, at)):
        at = m.end()
        ends.append(at)
        if at < len(text) and not text[at].isspace():
            break
    starts = [a, *(e + 1 for e in ends[:-1])]
    def accepted(i: int) -> int | None:
        for j in range(len(ends) - 1, i, -1):
            v = text[starts[i] : ends[j]]
            if _CARD_GROUPS.fullmatch(v) and seed_type(v, "") or _PHONE.fullmatch(v) or _LOCAL_PHONE.fullmatch(v) or _SSN.fullmatch(v):
                return j
        return i if seed_type(text[starts[i] : ends[i]], "") else None

    found = [accepted(i) for i in range(len(ends))]
    out, i = [], 0
    while i < len(ends):
        j = found[i]
        if j is None:
            stop = next((k for k in range(i + 1, len(ends)) if found[k] is not None), len(ends))
            j = next((j for j in range(stop - 1, i, -1) if joins(text[starts[i] : ends[j]])), i)
        out.append((starts[i], ends[j]))
        i = j + 1
    return out


def trim(text: str, a: int, z: int) -> tuple[int, int]:
    """Strips edges and the parentheses that are open, or stand around the whole value."""
    while a < z:
        v = text[a:z]
        left, right = v.count("("), v.count(")")
        if v[0] in _EDGE_L or v[0] == "(" and (left > right or v.find(")") == len(v) - 1):
            a += 1
        elif v[-1] in _EDGE_R or v[-1] == ")" and right > left:
            z -= 1
        else:
            break
    return a, z


def pieces(text: str, a: int, z: int) -> list[tuple[int, int]]:
    """The values of a token, which separators (= & : , parentheses, quotes) part; numbers, times and addresses keep theirs."""
    out = []
    for m in _PIECE.finditer(text, a, z):
        if m.lastgroup:
            out.append(m.span())
            continue
        b, e = trim(text, *m.span())
        v = text[b:e]
        if _NUMBER.fullmatch(v) or _COLONS.fullmatch(v) or _GROUP.fullmatch(v) or not any(c in v for c in ":,()"):
            out.append((b, e))
        else:
            out += [trim(text, *i.span()) for i in _INNER.finditer(text, b, e)]
    return [(b, e) for b, e in out if b < e]


def candidates_of(text: str) -> list[tuple[int, int, str, str | None, list[str]]]:
    """(start, end, value, seed type, patterns) of each token with a digit or @; digit groups that belong together are one."""
    out, at, n = [], 0, len(text)
    while (m := _MARK.search(text, at)) is not None:
        a = m.start()
        while a > at and not text[a - 1].isspace():
            a -= 1
        z = m.end()
        while z < n and not text[z].isspace():
            z += 1
        at = z
        b, e = a, z
        while b < e and (text[b] in _EDGE_L or text[b] == "(" and text.count("(", b, e) > text.count(")", b, e)):
            b += 1
        if b < e and _GROUP.fullmatch(text, b, e):
            spans = [trim(text, *s) for s in groups(text, b, e)]
        else:
            spans = pieces(text, a, z)
        at = max(at, *(e for _, e in spans)) if spans else at
        while at < n and not text[at].isspace():
            at += 1
        for a, z in spans:
            value = text[a:z]
            if _MARK.search(value):
                out.append((a, z, value, *_described(text, a, z)))
    out += [(a, z, text[a:z], "secret", _described(text, a, z)[1]) for a, z in cued(text)]
    return out


def cued(text: str) -> list[tuple[int, int]]:
    """The values without a digit or @ behind a secret's name."""
    out = []
    for m in _CUE.finditer(text) if ":" in text or "=" in text else ():
        a = z = m.end()
        while z < len(text) and not text[z].isspace():
            z += 1
        b, e = next(iter(pieces(text, a, z)), (z, z))
        if b == a and e - b >= 12 and not _MARK.search(text, b, e):
            out.append((b, e))
    return out


def context_of(text: str, a: int) -> str:
    """The two words before a place, whole, however far back they begin; = and : count as words."""
    size = 60
    while True:
        start = max(0, a - size)
        found = [m.group() for m in _WORD.finditer(text[start:a].lower()) if m.start() or not start]
        if len(found) > 1 or not start:
            return " ".join(found[-2:])
        size *= 4


def words_of(text: str, contexts: dict[str, set[str]]) -> list[tuple[int, int, str, str]]:
    """(start, end, value, context) of the values without a digit or @ that stand in one of the contexts, given by their last word."""
    out, last, known = [], None, set(cued(text))
    for m in _WORD.finditer(text):
        word, before, a = m.group().lower(), last, m.start()
        last = word
        if before not in contexts or word in "=:" or not (text[a - 1].isspace() or text[a - 1] in "=:&;,|<>[]{}\"'("):
            continue
        if (context := context_of(text, a)) in contexts[before]:
            z = a
            while z < len(text) and not text[z].isspace():
                z += 1
            b, e = next(iter(pieces(text, a, z)), (z, z))
            if b == a and e - b > 1 and not _MARK.search(text, b, e) and (b, e) not in known:
                out.append((b, e, text[b:e], context))
    return out


def _described(text: str, a: int, z: int) -> tuple[str | None, list[str]]:
    """The seed type and the patterns of the value at a place."""
    value, before = text[a:z], text[max(0, a - 60) : a]
    rough = shape(value, True)
    patterns = ["S " + shape(value)]
    if context := context_of(text, a):
        patterns.append(f"L {context} {rough}")
    if after := _AFTER.match(text, z):
        patterns.append(f"R {rough} {after.group(1).lower()}")
    if "@" in value:
        patterns.append("T @" + ".".join(value.rsplit("@", 1)[1].lower().split(".")[-2:]))
    return seed_type(value, before), patterns


_OCCURRENCE = [("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]


def _own(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(col(key).cast(id_types(docs, key)[0]).alias("id"), col(text).cast("string").alias("text"))


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, end, value, seed, patterns, context) of all candidates."""
    name, kind = id_types(docs, key)
    schema = pa.schema([("doc_id", kind), *_OCCURRENCE, ("seed", pa.string()), ("patterns", pa.list_(pa.string())), ("context", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                rows = [(i, *c, context_of(t, c[0])) for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()) if t for c in candidates_of(t)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return _own(docs, key, text).mapInArrow(run, f"doc_id {name}, start int, `end` int, value string, seed string, patterns array<string>, context string")


def word_occurrences(docs: DataFrame, contexts: dict[str, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, end, value, context) of the values without a digit or @ in the contexts given.

    A context comes with the number of distinct words that it bears; a task that has seen more of them gives no further
    rows for it, as those it gave settle that the context isn't confident.
    """
    name, kind = id_types(docs, key)
    schema = pa.schema([("doc_id", kind), *_OCCURRENCE, ("context", pa.string())])
    shared = docs.sparkSession.sparkContext.broadcast(contexts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, set[str]] = {}
        seen: dict[str, set[str]] = {}
        most = shared.value
        for c in most:
            known.setdefault(c.rsplit(" ", 1)[-1], set()).add(c)

        def alive(c: str, value: str) -> bool:
            words = seen.setdefault(c, set())
            if len(words) > most[c]:
                return False
            words.add(value)
            if len(words) > most[c]:
                known[c.rsplit(" ", 1)[-1]].discard(c)
            return True

        for batch in batches:
            for b in slices(batch, "text"):
                rows = [(i, *c) for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()) if t for c in words_of(t, known) if alive(c[3], c[2])]
                known = {w: cs for w, cs in known.items() if cs}
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return _own(docs, key, text).mapInArrow(run, f"doc_id {name}, start int, `end` int, value string, context string")


def words_in_context(docs: DataFrame, found: DataFrame, scores: DataFrame, key: str, text: str, s: Scratch) -> DataFrame | None:
    """Identifiers without a digit or @: what stands where nearly all else is an identifier. Each distinct word counts against its context."""
    seen = found.select("value", "context").filter("context <> ''").distinct().join(scores, "value")
    yes = F.coalesce(F.sum(F.when(F.col("score") > 0, F.col("score"))), F.lit(0.0))
    rest = F.count_if(F.col("negative")) + UNKNOWN_WEIGHT * F.count_if(~F.col("negative") & (F.col("score") <= 0))
    contexts = seen.groupBy("context").agg(yes.alias("yes"), rest.alias("rest"), F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    good = s.table(contexts.filter((F.col("yes") >= LEAST_SUPPORT) & (F.col("yes") / (F.col("yes") + F.col("rest")) >= LEAST_PATTERN)), "contexts")
    most = F.floor(F.col("yes") / LEAST_PATTERN - F.col("yes") - F.col("rest")).cast("int") + 1
    names = {r[0]: r[1] for r in good.select("context", most).toLocalIterator()}
    if not names:
        return None
    words = s.table(word_occurrences(docs, names, key, text), "words")
    counted = good.join(words.groupBy("context").agg(F.count_distinct("value").alias("words")), "context")
    sure = counted.withColumn("c", F.col("yes") / (F.col("yes") + F.col("rest") + F.col("words"))).filter(F.col("c") >= LEAST_PATTERN)
    given = sure.select("context", "kind", (F.least("c", F.lit(0.999)) * 0.95).alias("given")).filter(F.col("given") >= LEAST_INSTANCE)
    return words.join(given, "context").select("doc_id", "start", "end", "value", "kind", F.lit("pattern").alias("found_by"), F.round("given", 6).alias("confidence"))


def score_patterns(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """(pattern, confidence, kind): against instances known to be none, and the unknown at a small weight."""
    known = edges.join(scores, "value")
    yes = F.coalesce(F.sum(F.when(F.col("score") > 0, F.col("score"))), F.lit(0.0))
    no, unknown = F.count_if(F.col("negative")), F.count_if(~F.col("negative") & (F.col("score") <= 0))
    return (
        known.groupBy("pattern")
        .agg(yes.alias("yes"), no.alias("no"), unknown.alias("unknown"), F.max_by("kind", F.struct("score", "kind")).alias("kind"))
        .filter(F.col("yes") >= LEAST_SUPPORT)
        .select("pattern", (F.col("yes") / (F.col("yes") + F.col("no") + UNKNOWN_WEIGHT * F.col("unknown"))).alias("confidence"), "kind")
        .filter(F.col("confidence") >= LEAST_PATTERN)
    )


def identifiers(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, start, end, value, kind, found_by, confidence) of every identifier that occurs.

    start and end count characters. Words without a digit or @ are reported only where they stand in a confident context. found_by is 'seed', or 'pattern' for what only the patterns gave. Each distinct value
    counts once for a pattern however often it occurs; ties between kinds go to the later name. Null and empty texts have
    none; null identifiers stay null, and identifiers may be of any type; repeated rows report each their own; very long texts are read whole; an
    empty table gives no rows. Only the two named columns are read, so others' names don't matter.
    """
    s = Scratch(docs.sparkSession, "identifiers")
    found = s.table(occurrences(docs, key, text), "candidates")
    values = found.groupBy("value").agg(F.max(F.when(F.col("seed") != "", F.col("seed"))).alias("seed"), F.bool_or(F.coalesce(F.col("seed") == "", F.lit(False))).alias("plain"))
    negative = F.col("plain") & F.col("seed").isNull()
    base = s.table(values.select("value", "seed", negative.alias("negative")), "values")
    edges = s.table(found.select("value", F.explode("patterns").alias("pattern")).distinct(), "edges")
    scores = base.select("value", "negative", F.when(F.col("seed").isNotNull(), 1.0).otherwise(0.0).alias("score"), F.col("seed").alias("kind"))
    for r in range(rounds):
        patterns = score_patterns(edges, scores)
        given = edges.join(patterns, "pattern").groupBy("value").agg(
            (1 - F.exp(F.sum(F.log(1 - F.least(F.col("confidence"), F.lit(0.999)) * 0.95)))).alias("given"), F.max_by("kind", F.struct("confidence", "kind")).alias("k")
        )
        new = F.when(F.col("seed").isNotNull(), F.lit(1.0)).when(F.col("negative") | F.col("given").isNull() | (F.col("given") < LEAST_INSTANCE), F.lit(0.0)).otherwise(F.col("given"))
        old, scores = scores, s.table(base.join(given, "value", "left").select("value", "negative", new.alias("score"), F.coalesce("seed", F.when(new > 0, F.col("k"))).alias("kind")), f"scores{r}")
        s.drop(old)
    good = scores.filter("score > 0").join(base.select("value", F.col("seed").alias("s")), "value").select("value", "kind", "score", F.when(F.col("s").isNotNull(), "seed").otherwise("pattern").alias("found_by"))
    marked = found.join(good, "value").select("doc_id", "start", "end", "value", "kind", "found_by", F.round("score", 6).alias("confidence"))
    words = words_in_context(docs, found, scores, key, text, s)
    return s.finish(marked if words is None else marked.unionByName(words))
