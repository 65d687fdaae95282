"""Secret scans with multipart credential linking, in DataFrame functions only.

Base findings: `assign` (key words with a value), `access` (key identifiers) and `hex` (long
hexadecimal runs), each the leftmost non-overlapping matches of its pattern. Weak candidates are
credential parts that prove nothing alone: `id` (an identifier assignment), `opaque` (a long token of
mixed letters and digits) and `endpoint` (a URL or an address with a port). A weak candidate is
reported only when complementary parts co-occur in its scope:

* `opaque` with an identifier (`access` or `id`) or an `endpoint`,
* `id` with a secret (`assign`, `hex` or `opaque`),
* `endpoint` with an identifier and a secret.

A URL is no complement of a token inside it. A scope is `scope` characters on either side. The interval
join is a sweep inside the row: parts in order of start, one pass forwards and one backwards that carry
the nearest part of each role, so a weak candidate is linked with its nearest complements on
both sides and nothing is shuffled. The passes run in blocks of about the square root of the parts,
so a row's work grows with the power 1.5 of its parts at most. A weak candidate (other than an endpoint)
that overlaps a base finding is that finding and isn't reported again.

Positions are in code points, ends exclusive: a split by the pattern gives the gaps between matches,
and running sums of lengths give the places.

Defined cases: null and empty text have no findings; repeated rows are scanned each by itself; empty
tables give none; other columns are kept out unless named in `keep`.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.shared import kept_and_text

#: Patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Patterns of the weak kinds.
WEAK_ID = r"""(?i:(?:client|account|user|key)[_-]?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}"""
OPAQUE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}+={0,2}(?![A-Za-z0-9+/_=-])"
#: What an opaque token holds, tested on the whole token.
OPAQUE_HOLDS = ("[0-9]", "[A-Z]", "[a-z]")
ENDPOINT = r"(?i:https?://[a-z0-9.-]++(?::[0-9]{2,5})?(?:/[^\s\"'<>]*+)?|(?<![a-z0-9-])[a-z0-9-]++(?:\.[a-z0-9-]{1,63}+){1,8}+:[0-9]{2,5}\b)"
KINDS = ("assign", "access", "hex", "id", "opaque", "endpoint")

_SPAN = "array<struct<start:bigint,rank:int,end:bigint>>"
_EDGE = "struct<edge:bigint,start:bigint,rank:int,end:bigint>"
_NEAREST = f"struct<i:{_EDGE},s:{_EDGE},p:{_EDGE},q:{_EDGE}>"


def _running(items: str, zero: str, state: str, emitted: str, step: Callable, join: Callable, emit: Callable) -> str:
    """SQL for an array with emit(acc, x) for each item x, acc the state (of type `state`) of all items
    before it. step(acc, x) is the state with x, join(a, b) that of two runs of items in this order.

    An array can't be added to in place, so a single pass would copy what it has for each item. Blocks of
    about the square root of the items keep the copies short; their totals give each block's first state."""
    blocks = "transform(sequence(0, (size(v) - 1) div w), k -> slice(v, k * w + 1, w))"
    totals = f"transform(bs, b -> aggregate(b, {zero}, (acc, x) -> {step('acc', 'x')}))"
    starts = f"aggregate({totals}, named_struct('at', {zero}, 'out', cast(array() AS array<{state}>)), (t, y) -> named_struct('at', {join('t.at', 'y')}, 'out', concat(t.out, array(t.at))), t -> t.out)"
    inside = f"aggregate(b, named_struct('at', s0, 'out', cast(array() AS array<{emitted}>)), (t, x) -> named_struct('at', {step('t.at', 'x')}, 'out', concat(t.out, array({emit('t.at', 'x')}))), t -> t.out)"
    with_blocks = f"transform(array({blocks}), bs -> flatten(zip_with(bs, {starts}, (b, s0) -> {inside})))[0]"
    with_width = f"transform(array(cast(ceil(sqrt(size(v))) AS int)), w -> {with_blocks})[0]"
    return f"CASE WHEN size({items}) = 0 THEN cast(array() AS array<{emitted}>) ELSE transform(array({items}), v -> {with_width})[0] END"


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(text: str, pattern: str, rank: int, group: int = 0, least: int = 0, holds: tuple[str, ...] = ()) -> str:
    """SQL for the spans of a pattern's matches in the column `text`; the group has at least `least`
    characters and a match of each pattern of `holds`."""
    p = _literal(pattern)
    keep = " AND ".join([f"length(m.g) >= {least}", *(f"m.g RLIKE '{h}'" for h in holds)])
    gaps = f"arrays_zip(regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {group}), transform(split({text}, {p}, -1), x -> char_length(x)))"
    places = _running(
        gaps, "0L", "bigint", "struct<s:bigint,e:bigint,g:string>",
        lambda acc, m: f"{acc} + {m}.`2` + coalesce(char_length({m}.`0`), 0)",
        lambda a, b: f"{a} + {b}",
        lambda acc, m: f"named_struct('s', {acc} + {m}.`2`, 'e', {acc} + {m}.`2` + char_length({m}.`0`), 'g', {m}.`1`)",
    )
    return f"""
    CASE WHEN {text} RLIKE {p} THEN
      transform(filter({places}, m -> m.e IS NOT NULL AND {keep}), m -> named_struct('start', m.s, 'rank', {rank}, 'end', m.e))
    ELSE cast(array() AS {_SPAN}) END"""


def _uncovered(parts: str) -> str:
    """The parts without the weak ones (but endpoints) that overlap a base part."""
    reach = _running(parts, "-1L", "bigint", "bigint", lambda acc, x: f"CASE WHEN {x}.rank <= 2 THEN greatest({acc}, {x}.end) ELSE {acc} END", lambda a, b: f"greatest({a}, {b})", lambda acc, x: acc)
    far = "1000000000000000L"
    ahead = _running(f"reverse({parts})", far, "bigint", "bigint", lambda acc, x: f"CASE WHEN {x}.rank <= 2 THEN least({acc}, {x}.start) ELSE {acc} END", lambda a, b: f"least({a}, {b})", lambda acc, x: acc)
    both = f"zip_with({reach}, reverse({ahead}), (r, h) -> named_struct('r', r, 'h', h))"
    return f"transform(filter(zip_with({parts}, {both}, (x, y) -> named_struct('x', x, 'y', y)), z -> z.x.rank IN (0, 1, 2, 5) OR (z.y.r <= z.x.start AND z.y.h >= z.x.end)), z -> z.x)"


def _sweep(parts: str, back: bool) -> str:
    """For each part in order the nearest parts before it (after it, when back): an identifier i, a secret
    s, and the two nearest endpoints p and q."""
    edge, pick, other, far = ("start", "least", "greatest", "1000000000000000L") if back else ("end", "greatest", "least", "-1000000000000000L")
    none = f"named_struct('edge', {far}, 'start', 0L, 'rank', 0, 'end', 0L)"
    zero = f"named_struct('i', {none}, 's', {none}, 'p', {none}, 'q', {none})"

    def step(acc: str, x: str) -> str:
        own = f"named_struct('edge', {x}.{edge}, 'start', {x}.start, 'rank', {x}.rank, 'end', {x}.end)"
        last = f"{x}.rank = 5"
        return (
            f"named_struct('i', CASE WHEN {x}.rank IN (1, 3) THEN {pick}({acc}.i, {own}) ELSE {acc}.i END, 's', CASE WHEN {x}.rank IN (0, 2, 4) THEN {pick}({acc}.s, {own}) ELSE {acc}.s END,"
            f" 'p', CASE WHEN {last} THEN {pick}({acc}.p, {own}) ELSE {acc}.p END, 'q', CASE WHEN {last} THEN {pick}({acc}.q, {other}({acc}.p, {own})) ELSE {acc}.q END)"
        )

    def join(a: str, b: str) -> str:
        return f"named_struct('i', {pick}({a}.i, {b}.i), 's', {pick}({a}.s, {b}.s), 'p', {pick}({a}.p, {b}.p), 'q', {pick}({other}({a}.p, {b}.p), {a}.q, {b}.q))"

    out = _running(f"reverse({parts})" if back else parts, zero, _NEAREST, _NEAREST, step, join, lambda acc, x: acc)
    return f"reverse({out})" if back else out


def _linked(scope: int) -> str:
    """An array of (part, complements, reported) from the columns parts, before and after."""
    ends = []
    for role in "isp":
        f, k = f"y.before.{role}", f"y.after.{role}"
        if role == "p":  # not the endpoint that the part lies in
            f, k = "CASE WHEN y.before.p.edge <= y.parts.start THEN y.before.p ELSE y.before.q END", "CASE WHEN y.after.p.edge >= y.parts.end THEN y.after.p ELSE y.after.q END"
        ends += [f"named_struct('role', '{role}', 'o', {f}, 'gap', y.parts.start - ({f}).edge)", f"named_struct('role', '{role}', 'o', {k}, 'gap', ({k}).edge - y.parts.end)"]
    wanted = "(y.parts.rank = 3 AND e.role = 's') OR (y.parts.rank = 4 AND e.role <> 's') OR (y.parts.rank = 5 AND e.role <> 'p')"
    found = f"filter(array({', '.join(ends)}), e -> e.gap <= {scope} AND ({wanted}))"
    return f"""transform(arrays_zip(parts, before, after), y -> transform(array({found}), c -> named_struct('part', y.parts, 'others', c,
      'reported', y.parts.rank <= 2 OR (y.parts.rank < 5 AND size(c) > 0) OR (exists(c, e -> e.role = 'i') AND exists(c, e -> e.role = 's'))))[0])"""


def scan(docs: DataFrame, scope: int = 160, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns of `keep` (default: the id) with base_spans and all_spans: arrays of (start, rank, end),
    rank an index into KINDS, in order of start, then of kind; and links: an array of the reported
    weak candidates with their nearest complements, (start, rank, end, to_start, to_rank, to_end)."""
    keep = [id_col] if keep is None else keep
    rows = kept_and_text(docs, keep, text_col).select(F.struct(*keep).alias("kept"), F.coalesce("__text", F.lit("")).alias("text"))
    base = "concat(" + ",".join((_spans("text", ASSIGN, 0, group=2, least=6), _spans("text", ACCESS, 1), _spans("text", HEX, 2))) + ")"
    rows = rows.withColumn("base", F.array_sort(F.expr(base)))
    weak = "concat(" + ",".join((_spans("text", WEAK_ID, 3), _spans("text", OPAQUE, 4, holds=OPAQUE_HOLDS), _spans("text", ENDPOINT, 5))) + ")"
    rows = rows.withColumn("weak", F.expr(weak))
    rows = rows.withColumn("parts", F.expr("array_sort(concat(base, weak))"))
    rows = rows.withColumn("parts", F.expr(f"CASE WHEN size(weak) = 0 OR size(base) = 0 THEN parts ELSE {_uncovered('parts')} END"))
    for name, back in (("before", False), ("after", True)):
        rows = rows.withColumn(name, F.expr(f"CASE WHEN size(weak) = 0 THEN cast(array() AS array<{_NEAREST}>) ELSE {_sweep('parts', back)} END"))
    linked = f"filter({_linked(scope)}, z -> z.reported)"
    rows = rows.withColumn("linked", F.expr(f"CASE WHEN size(weak) > 0 THEN {linked} END"))
    rows = rows.withColumn("all", F.expr("CASE WHEN size(weak) = 0 THEN base ELSE transform(linked, z -> z.part) END"))
    link = "named_struct('start', z.part.start, 'rank', z.part.rank, 'end', z.part.end, 'to_start', e.o.start, 'to_rank', e.o.rank, 'to_end', e.o.end)"
    links = f"coalesce(flatten(transform(linked, z -> transform(z.others, e -> {link}))), array())"
    return rows.select("kept.*", F.col("base").alias("base_spans"), F.col("all").alias("all_spans"), F.expr(links).alias("links"))


def joined(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = "array(" + ",".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, s -> concat(element_at({kinds}, s.rank + 1), ':', s.start, ':', s.end)), ',')")


def joined_links(links: str) -> Column:
    """kind:start:end>kind:start:end of each link, comma-joined."""
    kinds = "array(" + ",".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({links}, s -> concat(element_at({kinds}, s.rank + 1), ':', s.start, ':', s.end, '>', element_at({kinds}, s.to_rank + 1), ':', s.to_start, ':', s.to_end)), ',')")


def digest(docs: DataFrame, scope: int = 160, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, links for every row."""
    found = scan(docs, scope, id_col, text_col)

    def count(rank: int) -> Column:
        return F.expr(f"cast(size(filter(base_spans, s -> s.rank = {rank})) AS bigint)")

    return found.select(F.col(id_col).cast("long").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("all_spans").alias("spans"), joined_links("links").alias("links"))


def redact(docs: DataFrame, mask: str = "[secret]", scope: int = 160, text_col: str = "text") -> DataFrame:
    """docs with every found span of the text replaced by the mask; other columns, and texts without
    findings, as they are. Overlapping spans are replaced as one."""
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    at = columns.index(text_col)
    found = scan(plain, scope, text_col=f"c{at}", keep=plain.columns)
    # the gaps between spans, cut out of blocks of the text, as a substring is sought from its text's start
    reach = _running("all_spans", "0L", "bigint", "bigint", lambda acc, x: f"greatest({acc}, {x}.end)", lambda a, b: f"greatest({a}, {b})", lambda acc, x: acc)
    gaps = f"transform(filter(zip_with(all_spans, {reach}, (x, r) -> named_struct('from', r, 'to', x.start)), g -> g.to >= g.from), g -> named_struct('from', cast(g.from AS int), 'size', cast(g.to - g.from AS int)))"
    inside = f"transform(array(substring(c{at}, b[0].from + 1, element_at(b, -1).from + element_at(b, -1).size - b[0].from)), t -> transform(b, g -> substring(t, g.from - b[0].from + 1, g.size)))[0]"
    blocks = f"transform(array(cast(ceil(sqrt(size(gs))) AS int)), w -> flatten(transform(sequence(0, (size(gs) - 1) div w), k -> transform(array(slice(gs, k * w + 1, w)), b -> {inside})[0])))[0]"
    tail = f"substring(c{at}, cast(array_max(transform(all_spans, x -> x.end)) AS int) + 1)"
    merged = f"array_join(concat(transform(array({gaps}), gs -> {blocks})[0], array({tail})), {_literal(mask)})"
    text = F.when(F.size("all_spans") > 0, F.expr(merged)).otherwise(F.col(f"c{at}"))
    return found.select([text if i == at else F.col(f"c{i}") for i in range(len(columns))]).toDF(*columns)
