"""Personal data by patterns, widened by bootstrapped contextual extraction.

Base spans come from four patterns (email, ip, card, phone).  Their strings are the
seed entities.  A candidate is an identifier-like token, or digit groups set apart by
single spaces or parentheses, after a word; an instance is its string.  It fits four
lexical patterns, from strict to loose: the word before with the shape (characters by
class, runs with their length), the word before with the shape of collapsed runs, the
words before and after, and the word before alone.  The last two take any form, so that
forms the base patterns don't know are found where seeds stand.

The pattern-instance graph of the corpus is scored iteratively in Spark: a pattern's
confidence is the mean confidence of its distinct instances, discounted for little
support; an instance's is 1 for seeds, else the noisy-or of its confident patterns'.
Support is the number of distinct instances of at least CONFIDENT, seeds or found in an
earlier round, so a pattern can stand on what others have found.  Patterns of at least
CONFIDENT with a support of at least SUPPORT mark all candidates that they fit as spans
of kind ctx, unless a base span covers them.

Candidates hold a digit or an @, so the graph is far smaller than the corpus; it
is aggregated to distinct (pattern, instance) pairs with their seed flag.  Each
iteration is two joins and two aggregations of that graph by pattern and by instance,
with map-side combining.  The confident patterns are joined back to the candidates,
which are kept by row key, so no pattern list is held in memory.

Defined cases: a null or empty text has no spans; repeated ids get a row each; other
columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routewise.llm.common import prepare, stored

#: The base patterns, in order of listing.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only start where a run of digits does, and takes its runs whole
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")
#: Characters that an email's part before the @ may have.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

TOKEN = re.compile(r"[^\s,;!?\"'()\[\]{}<>|]+")
#: What makes a token a candidate.
MARK = re.compile(r"[0-9@]")
#: Besides white space, what may stand between a word and the token after it.
AFTER_WORD = frozenset(":=#\"'(")
LETTER = re.compile(r"[^\W\d_]")
WORD_AFTER = re.compile(r"[\s:=#\"'().,;!?]*([^\W\d_]+)")
#: Groups of digits, and what may stand between two groups of one identifier.
GROUP = re.compile(r"\+?[0-9][0-9.-]*")
BETWEEN = frozenset((" ", " (", ") ", ")"))
CONFIDENT = 0.9
SUPPORT = 4


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping emails.  The search starts at each @ and walks back over
    the characters that may precede it, so long runs without one cost nothing."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            out.append(m.span())
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, *s) for s in emails(text)]
    for m in IP.finditer(text):
        if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


def shape(token: str) -> str:
    """Classes of characters, runs with their length: ab12-3 -> a2d2-1d1."""
    return "".join(f"{m[1]}{len(m[0])}" for m in re.finditer(r"(.)\1*", _classes(token)))


def _classes(token: str) -> str:
    return "".join("d" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in token)


def patterns(before: str, after: str, token: str) -> list[str]:
    """The lexical patterns that a token between two words fits, strict ones first."""
    loose = re.sub(r"(.)\1+", r"\1", _classes(token))
    return [f"{before}\x01{shape(token)}", f"{before}\x02{loose}", f"{before}\x03{after}", f"{before}\x04"]


def tokens(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, bool]]:
    """(start, end, is a base span): base spans that hold tokens, other tokens, and groups
    of digits that belong together as one."""
    out, covered = [], sorted((s, e) for _, s, e in spans)
    i, whole = 0, False
    for m in TOKEN.finditer(text):
        s, e = m.span()
        if not MARK.search(text, s, e):
            continue
        while e > s and text[e - 1] in ".:-":
            e -= 1
        while i < len(covered) and covered[i][1] <= s:
            i += 1
        if i < len(covered) and covered[i][0] < e:
            # a base span, whole, is the seed entity
            if e - s >= 5:
                out.append((*covered[i], True))
            whole = False
            continue
        group = GROUP.fullmatch(text, s, e) is not None
        between = text[out[-1][1]:s] if whole and group and text[s] != "+" else ""
        if between in BETWEEN:
            first = out[-1][0]
            # the parenthesis that is closed between the groups
            if between[0] == ")" and "(" not in text[first:out[-1][1]] and text[first - 1:first] == "(":
                first -= 1
            out[-1] = (first, e, False)
        else:
            out.append((s, e, False))
        whole = group and e == m.end()
    return [x for x in out if x[1] - x[0] >= 5]


def word_before(text: str, at: int) -> str:
    """The whole word before a position, however far the separators reach; empty if there
    is none.  It never walks past another token, so a text is walked once at most."""
    while at > 0 and (text[at - 1].isspace() or text[at - 1] in AFTER_WORD):
        at -= 1
    start = at
    while start > 0 and LETTER.match(text[start - 1]):
        start -= 1
    return text[start:at]


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, list[str], str, bool]]:
    """(start, end, patterns, instance, is a seed): identifier-like tokens with a word
    before them."""
    out = []
    for s, e, seed in tokens(text, spans):
        before = word_before(text, s)
        if before:
            after = WORD_AFTER.match(text, e)
            out.append((s, e, patterns(before.lower(), after[1].lower() if after else "", text[s:e]), text[s:e], seed))
    return out


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, spans, cands): base spans and candidates of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_t = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        cands_t = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("patterns", pa.list_(pa.string())), ("instance", pa.string()), ("seed", pa.bool_())]))
        for b in batches:
            spans, cands = [], []
            for x in b.column(1):
                text = x.as_py() or ""
                if not MARK.search(text):
                    spans.append([])
                    cands.append([])
                    continue
                found = base_spans(text)
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
                cands.append([{"start": s, "end": e, "patterns": p, "instance": t, "seed": seed} for s, e, p, t, seed in candidates(text, found)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, spans_t), pa.array(cands, cands_t)], names=["doc_id", "spans", "cands"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, spans array<struct<kind:int,start:int,end:int>>, "
                        "cands array<struct<start:int,end:int,patterns:array<string>,instance:string,seed:boolean>>"))


def score_patterns(pairs: DataFrame) -> DataFrame:
    """(pattern, confidence, support) from distinct (pattern, instance, seed) pairs.

    confidence = mean instance confidence * support / (support + 0.25).  Rounds go on until
    no further pattern is confident: confidences only grow from round to round, so the
    confident patterns do too, and there are as many rounds as links from the seeds to the
    last pattern that they lead to."""
    inst = pairs.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("conf"))
    before = -1
    while True:
        scored = pairs.join(inst, "instance")
        support = F.sum((F.col("conf") >= CONFIDENT).cast("long"))
        pattern = scored.groupBy("pattern").agg((F.avg("conf") * support / (support + 0.25)).alias("confidence"), support.alias("support")).checkpoint()
        sure = (F.col("confidence") >= CONFIDENT) & (F.col("support") >= SUPPORT)
        now = pattern.where(sure).count()
        if now == before:
            return pattern
        before = now
        # a pattern below the bar lends nothing, so noise doesn't add up
        lent = F.when(sure, F.col("confidence")).otherwise(0.0)
        inst = (pairs.join(pattern.select("pattern", lent.alias("lent")), "pattern").groupBy("instance")
                .agg(F.when(F.max("seed"), 1.0).otherwise(1 - F.exp(F.sum(F.log(1 - F.least("lent", F.lit(0.999)))))).alias("conf")))
        inst = inst.checkpoint()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: array<struct<kind, start, end>> by kind (base kinds, then ctx),
    then start."""
    prepare(docs.sparkSession)
    # a row key for repeated ids; stored, so that it stays the same
    rows = stored(_found(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pii")
    cands = rows.where(F.size("cands") > 0).select("row", F.explode("cands").alias("c")).select("row", "c.*")
    cands = cands.select("row", "start", "end", "instance", "seed", F.explode("patterns").alias("pattern"))
    pairs = cands.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")).checkpoint()
    good = score_patterns(pairs).where((F.col("confidence") >= CONFIDENT) & (F.col("support") >= SUPPORT)).select("pattern")
    extra = (cands.where(~F.col("seed")).join(good, "pattern").groupBy("row")
             .agg(F.collect_set(F.struct(F.lit(len(KINDS)).alias("kind"), "start", "end")).alias("extra")))
    return (rows.select("row", "doc_id", "spans").join(extra, "row", "left")
            .select("doc_id", F.array_sort(F.concat("spans", F.coalesce("extra", F.array().cast("array<struct<kind:int,start:int,end:int>>")))).alias("spans")))


def digest(spans: DataFrame) -> DataFrame:
    """Counts by base kind, hash of the base spans, and all spans as text."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "ctx")])

    def text(x):
        return F.array_join(F.transform(x, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")

    def count(k):
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")

    return spans.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
                        F.sha2(text(F.filter("spans", lambda s: s["kind"] < len(KINDS))), 256).alias("base_sha256"),
                        text(F.col("spans")).alias("spans"))


def digest_of(text: str) -> str:
    """base_sha256 of one text, for tests."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in base_spans(text)).encode()).hexdigest()
