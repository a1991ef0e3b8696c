"""Secret scan with built-in Spark SQL functions only.

Three pattern kinds (assign, access, hex) give the base spans.  On top of them,
candidate strings (maximal runs of base64 or URL-safe characters) are scanned by a
sliding window: the Shannon entropy of the window is kept up to date from the counts
of its characters, of which one enters and one leaves at each step.  Windows above
their character class's threshold are merged into spans of kind entropy_hex or
entropy_b64.  Candidates on the allow-list (plain words, numbers, UUIDs, known
digests, caller's own patterns) are suppressed.

Entropy is kept in whole numbers: the sum of c * log2(c) over the window's counts,
with c * log2(c) taken from a table in units of 2**-20, so results don't depend on
the order of floating-point sums.  H = log2(W) - sum / W.

Everything happens in the row: no shuffle, no Python.  Texts without a match of a
kind's cheap pre-test skip its work.

Defined cases: a null or empty text has no spans; repeated ids give a row each; other
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routewise.llm.common import text_of

#: Pattern, least length of group (0: the match), its pre-test.
KINDS = {
    "assign": (r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
PRETEST = {"assign": r"[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}

#: Candidate strings, and by class: alphabet, window, least entropy in bits.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
CLASSES = {
    "entropy_hex": ("0123456789abcdef", 24, 3.0),
    "entropy_b64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=", 20, 3.85),
}
#: Candidates that are no secrets: without a digit, or without a letter; dashed words
#: and numbers (slugs, dates, paths); UUIDs; digests of the empty input.
ALLOW = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^([A-Za-z]+|[0-9]{1,8})([-_/=+]+([A-Za-z]+|[0-9]{1,8}))*[-_/=+]*$",
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"^(d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709|e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855)$",
)
UNIT = 1 << 20


def c_log_c(window: int) -> list[int]:
    """c * log2(c) in units of 2**-20 for counts 0 to window."""
    return [round(c * math.log2(c) * UNIT) if c > 1 else 0 for c in range(window + 1)]


def most_sum(window: int, bits: float) -> int:
    """The largest sum of c * log2(c) at which a window has that entropy."""
    return math.floor(window * (math.log2(window) - bits) * UNIT)


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<s, e, v>>: leftmost non-overlapping matches with their code-point
    spans and the group's text.  Positions add up the pieces between the matches."""
    z = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
                     F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"),
                     F.split(text, pattern, -1).alias("p"))
    none = F.array().cast("array<struct<s:int,e:int,v:string>>")

    def step(a, x):
        m, v, p = (x.getField(n) for n in ("m", "v", "p"))
        s = a["pos"] + F.length(p)
        e = s + F.length(m)
        return F.when(m.isNull(), a).otherwise(F.struct(
            e.alias("pos"), F.array_append(a["out"], F.struct(s.alias("s"), e.alias("e"), v.alias("v"))).alias("out")))

    return F.aggregate(z, F.struct(F.lit(0).alias("pos"), none.alias("out")), step, lambda a: a["out"])


def spans_of(kind: str, text: Column) -> Column:
    pattern, group, least = KINDS[kind]
    spans = F.filter(found(text, pattern, group), lambda x: F.length(x["v"]) >= least)
    return F.when(text.rlike(PRETEST[kind]), spans).otherwise(F.array().cast("array<struct<s:int,e:int,v:string>>"))


def hot_windows(word: Column, kind: str) -> Column:
    """array<struct<s, e>> in the candidate: merged windows of high entropy."""
    alphabet, window, bits = CLASSES[kind]
    table = F.array(*[F.lit(x).cast("long") for x in c_log_c(window)])
    limit = most_sum(window, bits)
    codes = F.transform(F.split(word, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    # what enters with what leaves, -1 for nothing, and the end of the window
    lagged = F.concat(F.array_repeat(F.lit(-1), window), codes)
    moves = F.filter(F.transform(F.arrays_zip(codes.alias("i"), lagged.alias("o")), lambda x, k: F.struct(
        x.getField("i").alias("i"), x.getField("o").alias("o"), (k + 1).alias("e"))), lambda x: x["i"].isNotNull())
    none = F.array().cast("array<struct<s:int,e:int>>")
    zero = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("n"), F.lit(0).cast("long").alias("sum"),
                    F.lit(-1).alias("s"), F.lit(-1).alias("e"), none.alias("out"))

    def log_of(c):
        return F.element_at(table, c + 1)

    def step(a, x):
        counts, i, o = a["n"], x["i"], x["o"]
        left = F.when(o < 0, F.lit(0)).otherwise(F.element_at(counts, o + 1))
        here = F.element_at(counts, i + 1) - F.when(o == i, 1).otherwise(0)
        total = (a["sum"] - log_of(left) + log_of(F.greatest(left - 1, F.lit(0))) + log_of(here + 1) - log_of(here))
        n = F.transform(counts, lambda c, k: c + F.when(k == i, 1).otherwise(0) - F.when(k == o, 1).otherwise(0))
        hot = (x["e"] >= window) & (total <= limit)
        joins = hot & (a["s"] >= 0) & (x["e"] - window <= a["e"])
        return F.struct(
            n.alias("n"), total.alias("sum"),
            F.when(joins | ~hot, a["s"]).otherwise(x["e"] - window).alias("s"),
            F.when(hot, x["e"]).otherwise(a["e"]).alias("e"),
            F.when(hot & ~joins & (a["s"] >= 0), F.array_append(a["out"], F.struct(a["s"].alias("s"), a["e"].alias("e")))).otherwise(a["out"]).alias("out"))

    def last(a):
        return F.when(a["s"] >= 0, F.array_append(a["out"], F.struct(a["s"].alias("s"), a["e"].alias("e")))).otherwise(a["out"])

    return F.aggregate(moves, zero, step, last)


def entropy_spans(kind: str, text: Column, allow: tuple[str, ...]) -> Column:
    window = CLASSES[kind][1]
    is_hex = r"^([0-9a-f]+|[0-9A-F]+)$"

    def fits(c):
        of_class = c["v"].rlike(is_hex) if kind == "entropy_hex" else ~c["v"].rlike(is_hex)
        return of_class & (F.length(c["v"]) >= window) & ~c["v"].rlike("|".join(f"(?:{p})" for p in allow))

    def spans(c):
        word = F.lower(c["v"]) if kind == "entropy_hex" else c["v"]
        return F.transform(hot_windows(word, kind), lambda w: F.struct((c["s"] + w["s"]).alias("s"), (c["s"] + w["e"]).alias("e")))

    out = F.flatten(F.transform(F.filter(found(text, CANDIDATE), fits), spans))
    return F.when(text.rlike(CANDIDATE), out).otherwise(F.array().cast("array<struct<s:int,e:int>>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, spans: array<struct<start, end, kind>> by start, then kind in order
    of listing (base kinds, then entropy classes)."""
    kinds = [*KINDS, *CLASSES]
    d = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    parts = [spans_of(k, F.col("text")) for k in KINDS] + [entropy_spans(k, F.col("text"), (*ALLOW, *allow)) for k in CLASSES]

    def ranked(rank):
        return lambda x: F.struct(x["s"].alias("start"), F.lit(rank).alias("rank"), x["e"].alias("end"))

    tagged = [F.transform(p, ranked(r)) for r, p in enumerate(parts)]
    names = F.array(*[F.lit(k) for k in kinds])
    return d.select("doc_id", F.transform(F.array_sort(F.concat(*tagged)), lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), F.element_at(names, x["rank"] + 1).alias("kind"))).alias("spans"))


def digest(found_spans: DataFrame) -> DataFrame:
    """Counts by base kind, hash of the base spans, and all spans as text."""

    def text(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def of(kind):
        return F.filter("spans", lambda x: x["kind"] == kind)

    return found_spans.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(text(F.filter("spans", lambda x: x["kind"].isin(*KINDS))), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def oracle_sql() -> str:
    """DuckDB SQL of the digest: spans by windowed sums over split pieces, entropy by
    counting each window's characters anew."""
    kinds = [*KINDS, *CLASSES]
    q = lambda s: s.replace("'", "''")
    # the positions of group 2 are not needed: only its length
    ctes = ["d as (select doc_id, row_number() over () as rid, coalesce(text, '') as text from documents)"]
    sources = []

    def matches(name, pattern, group, keep):
        ctes.append(
            f"{name}_m as (select rid, unnest(regexp_extract_all(text, '{q(pattern)}', 0)) as m, unnest(regexp_extract_all(text, '{q(pattern)}', {group})) as v, "
            f"generate_subscripts(regexp_extract_all(text, '{q(pattern)}', 0), 1) as k from d)")
        ctes.append(
            f"{name}_p as (select rid, unnest(string_split_regex(text, '{q(pattern)}')) as p, generate_subscripts(string_split_regex(text, '{q(pattern)}'), 1) as k "
            f"from d where regexp_matches(text, '{q(pattern)}'))")
        ctes.append(
            f"{name}_s as (select rid, v, cast(sum(length(p)) over w + coalesce(sum(length(m)) over (partition by rid order by k rows between unbounded preceding and 1 preceding), 0) as bigint) as s, "
            f"length(m) as n from {name}_m join {name}_p using (rid, k) window w as (partition by rid order by k))")
        ctes.append(f"{name} as (select rid, v, s, s + n as e from {name}_s where {keep})")

    for r, (k, (pattern, group, least)) in enumerate(KINDS.items()):
        matches(k, pattern, group, f"length(v) >= {least}")
        sources.append(f"select rid, s, e, {r} as rank, '{k}' as kind from {k}")
    allow = " or ".join(f"regexp_matches(v, '{q(p)}')" for p in ALLOW)
    matches("cand", CANDIDATE, 0, f"not ({allow})")
    is_hex = "regexp_matches(v, '^([0-9a-f]+|[0-9A-F]+)$')"
    for r, (k, (_, w, bits)) in enumerate(CLASSES.items(), len(KINDS)):
        of_class = is_hex if k == "entropy_hex" else f"not {is_hex}"
        table = "[" + ",".join(map(str, c_log_c(w))) + "]"
        ctes.append(f"{k}_w as (select rid, s as c, v, unnest(range(0, length(v) - {w - 1})) as i from cand where {of_class} and length(v) >= {w})")
        ctes.append(f"{k}_n as (select rid, c, i, ch, count(*) as n from (select rid, c, i, unnest(string_split({'lower(' if r == len(KINDS) else '('}substr(v, i + 1, {w})), '')) as ch from {k}_w) group by all)")
        ctes.append(f"{k}_h as (select rid, c, i from {k}_n group by all having sum({table}[n + 1]) <= {most_sum(w, bits)})")
        ctes.append(f"{k}_g as (select *, sum(new) over (partition by rid, c order by i) as g from (select *, case when i - lag(i) over (partition by rid, c order by i) <= {w} then 0 else 1 end as new from {k}_h))")
        ctes.append(f"{k} as (select rid, c + min(i) as s, c + max(i) + {w} as e from {k}_g group by rid, c, g)")
        sources.append(f"select rid, s, e, {r} as rank, '{k}' as kind from {k}")
    ctes.append("spans as (" + " union all ".join(sources) + ")")
    base = ", ".join(f"'{k}'" for k in KINDS)
    counts = ", ".join(f"count(*) filter (where kind = '{k}') as n_{k}" for k in KINDS)
    joined = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, rank)%s, '')"
    return ("with " + ",\n".join(ctes) + f"\nselect any_value(doc_id) as doc_id, {counts}, sha256({joined % f' filter (where kind in ({base}))'}) as base_sha256, "
            f"{joined % ''} as spans from d left join spans using (rid) group by rid")
