"""Personal data: base patterns as seeds, and contexts learned from them that find identifiers of other forms.

Everything here is a DataFrame or SQL expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubflow.llm.common import written
from hubflow.operators.keyset import KeyBits

KINDS = ("email", "ip", "card", "phone")

# Each regular expression finds the matches of the base pattern, leftmost and without overlap, but tests its first
# character before anything else, starts only where a match can begin, and keeps what it has taken, so that no run
# of similar characters is read twice. A card's digits are counted here, since a run of digits is taken whole anyway.
MATCH = {
    "email": r"[A-Za-z0-9._%+-](?:(?<=\G.)|(?<![A-Za-z0-9._%+-].))[A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A cheap test that a text must pass to hold the kind at all.
HINT = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Tokens that look like an identifier: three digits in a row, a spelt-out at sign, seven digits over separators, or groups of an
#: address, with digit groups that follow. Whatever a form below accepts behind white space, a name or a quote starts like this.
CANDIDATE = (
    r"(?<!\S)\S*?(?:[0-9]{3}|[@]|[(\[]at[)\]]|[0-9](?:[\x20()./-]{0,2}[0-9]){6}|(?<![0-9A-Za-z])[0-9A-Fa-f]{1,4}(?:[.:][0-9A-Fa-f]{0,4}){2,6}[.:][0-9A-Fa-f])"
    r"\S*+(?:[\x20()./-]{1,2}[0-9][0-9().-]*+)*+"
)
#: Forms that a learned context may add to each kind.
FORM = {
    "email": r"^[A-Za-z0-9._%+-]+(?:@|\(at\)|\[at\])[A-Za-z0-9-]\S*$",
    "ip": r"^[0-9A-Fa-f]{1,4}(?:[.:][0-9A-Fa-f]{0,4}){3,7}$",
    "card": r"^[0-9](?:[\x20./-]?[0-9]){11,18}$",
    "phone": r"^\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,14}$",
}
#: Quotes and brackets before a token, also a round one unless it opens an area code; marks after it; a name before = or : in it.
LEAD = r"(?:[\"'\[<{]|\((?![0-9]{1,5}\)))*"
TAIL = r"[].,;:!?)}>\"']+$"
IP = FORM["ip"].strip("^$")
NAME = rf"^(?:\S*?[A-Za-z_][=:](?={IP}$)|\S*[A-Za-z_][=:](?=\S))"
#: What may be glued to a base match: quotes, brackets and a name.
GLUED = r"^[\"'\[<{(]*(\S*[A-Za-z_][=:])?[\"'\[<{(]*$"
#: Characters to the left that hold a context.
REACH = 64
#: Bits of one of Spark's bitmaps, and of the filter of word pairs that is made of sixteen.
BITMAP = 32768
SLOTS = 16 * BITMAP


def _quoted(regex: str) -> str:
    return "r'" + regex.replace("'", r"\x27") + "'"


def _spans(text: str, found: str, regex: str) -> str:
    """SQL for the places of the matches in ``found``: they and the pieces between them, in turn, make up the text."""
    pieces = f"split({text}, {_quoted(regex)}, -1)"
    return (
        f"aggregate(filter(zip_with({pieces}, {found}, (g, v) -> named_struct('gap', length(g), 'n', length(v), 'value', v)), x -> x.value IS NOT NULL), "
        "named_struct('at', 0, 'out', CAST(array() AS array<struct<start:int,stop:int,value:string>>)), "
        "(a, x) -> named_struct('at', a.at + x.gap + x.n, 'out', concat(a.out, array(named_struct('start', a.at + x.gap, 'stop', a.at + x.gap + x.n, 'value', x.value)))), "
        "a -> a.out)"
    )


def _holds(kind: str, value: str) -> str:
    """SQL for the test that a match of a base pattern must pass."""
    digits = f"regexp_replace({value}, '[^0-9]', '')"
    if kind == "ip":
        return rf"{value} RLIKE r'^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{{2}}|[0-9]{{1,2}})(?:[.]|$)){{4}}$'"
    if kind == "card":
        # Luhn, from the right: every second digit counts double, less 9 beyond 9.
        each = f"CAST(substr(reverse({digits}), i, 1) AS int) * IF(i % 2 = 0, 2, 1)"
        return f"aggregate(sequence(1, length({digits})), 0, (s, i) -> s + {each} - IF({each} > 9, 9, 0)) % 10 = 0"
    if kind == "phone":
        return f"length({digits}) BETWEEN 9 AND 15"
    return "true"


def _left(text: str, start: str) -> str:
    """SQL for the characters before a place that may hold its context."""
    return f"substring({text}, greatest(1, {start} - {REACH - 1}), least({start}, {REACH}))"


def _plain(words: str) -> str:
    return f"regexp_replace(lower({words}), '[0-9]', '0')"


def _context(text: str, start: str) -> str:
    """SQL for the two words before a place (one, if the text starts with it), lower-cased, digits as 0, with one blank for white space; or null."""
    # A word cut off by the window's left end is no word.
    words = rf"regexp_extract({_left(text, start)}, IF({start} > {REACH}, r'\s(\S+\s+\S+\s+)$', r'(?:^|\s)((?:\S+\s+)?\S+\s+)$'), 1)"
    return f"nullif(regexp_replace({_plain(words)}, r'\\s+', ' '), '')"


def _contexts(name: str, left: str) -> str:
    """SQL for the contexts of a token: the words before it, or the name glued to it, alone and with the words before."""
    return f"filter(IF({name} = '', array({left}), array({name}, concat({left}, {name}))), c -> c IS NOT NULL)"


def _name(core: str) -> str:
    """SQL for the name before = or : that a token without quotes, brackets and closing marks starts with, or ''. An address of groups has none."""
    return f"IF({core} RLIKE {_quoted(FORM['ip'])}, '', regexp_extract({core}, {_quoted(NAME)}, 0))"


def _core(value: str) -> str:
    return f"regexp_replace(regexp_replace({value}, {_quoted('^' + LEAD)}, ''), {_quoted(TAIL)}, '')"


def located(docs: DataFrame) -> DataFrame:
    """``row, doc_id, text_hash, base, other`` per row: base spans of all kinds in order, and other identifier-like tokens, each with its contexts."""
    slim = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    found = slim
    for kind in KINDS:
        hint = f"contains(text, '{HINT[kind]}')" if HINT[kind] else "true"
        found = found.withColumn(f"m_{kind}", F.expr(f"IF({hint}, regexp_extract_all(text, {_quoted(MATCH[kind])}, 0), array())"))
    found = found.withColumn("m_other", F.expr(f"regexp_extract_all(text, {_quoted(CANDIDATE)}, 0)"))
    for kind in (*KINDS, "other"):
        regex = CANDIDATE if kind == "other" else MATCH[kind]
        empty = "CAST(array() AS array<struct<start:int,stop:int,value:string>>)"
        found = found.withColumn(f"s_{kind}", F.expr(f"IF(size(m_{kind}) > 0, {_spans('text', f'm_{kind}', regex)}, {empty})"))
    # Quotes and marks around a token are not part of it; a name before = or : is its context.
    glued = f"regexp_extract({_left('text', 'x.start')}, r'\\S*$', 0)"
    named = f"IF(length(x.glued) < {REACH} AND x.glued RLIKE {_quoted(GLUED)}, {_plain(f'regexp_extract(x.glued, {_quoted(GLUED)}, 1)')}, NULL)"
    before = _context("text", "(x.start - length(x.glued))")
    base = ", ".join(
        f"transform(transform(filter(s_{kind}, x -> {_holds(kind, 'x.value')}), x -> named_struct('start', x.start, 'stop', x.stop, 'value', x.value, 'glued', {glued})), "
        f"x -> named_struct('start', x.start, 'rank', {rank}, 'stop', x.stop, 'value', x.value, 'contexts', {_contexts(named, before)}))"
        for rank, kind in enumerate(KINDS)
    )
    lead = f"length(regexp_extract(x.value, {_quoted('^' + LEAD)}, 0))"
    inner = f"regexp_extract(substring(y.core, length(y.name) + 1), {_quoted('^' + LEAD)}, 0)"
    other = (
        f"transform(transform(transform(s_other, x -> named_struct('start', x.start + {lead}, 'core', {_core('x.value')}, 'left', {_context('text', 'x.start')})), "
        f"x -> named_struct('start', x.start, 'core', x.core, 'left', x.left, 'name', {_name('x.core')})), "
        f"y -> named_struct('start', y.start + length(y.name) + length({inner}), 'stop', y.start + length(y.core), "
        f"'value', substring(y.core, length(y.name) + length({inner}) + 1), 'contexts', {_contexts(_plain('y.name'), 'y.left')}))"
    )
    found = found.withColumn("base", F.expr(f"array_sort(concat({base}))"))
    found = found.withColumn("other", F.expr(other))
    apart = "filter(other, y -> length(y.value) > 0 AND NOT exists(base, b -> b.start < y.stop AND y.start < b.stop))"
    return found.select("row", "doc_id", "text_hash", "base", F.expr(apart).alias("other"))


def _flags(pairs: DataFrame) -> Column:
    """The low bits of all ``pair`` as an array of ``SLOTS / 8`` bytes: one value of a fixed size, whatever the number of pairs."""
    each = ", ".join(f"bitmap_construct_agg(slot % {BITMAP}) FILTER (WHERE slot div {BITMAP} = {i})" for i in range(SLOTS // BITMAP))
    bits = pairs.select(F.expr(f"pair & {SLOTS - 1}L AS slot")).agg(F.expr(f"concat({each}) AS bits"))
    return bits.select(F.expr("transform(sequence(1, length(bits)), i -> CAST(conv(hex(substring(bits, i, 1)), 16, 10) AS int))")).scalar()


def context_totals(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """``context, total``: how often each of the given contexts (``context, led``) stands anywhere, whatever follows.

    A filter of fixed size drops most other words at the scan; what passes is counted per task before it is
    shuffled, and only the counts meet the contexts. Words that pass by chance find no context there. A context
    stands at least as often as it led to a candidate.
    """
    words = "filter(split(regexp_replace(lower(text), '[0-9]', '0'), r'\\s+'), w -> w <> '')"
    pairs = "transform(slice(w, 1, greatest(size(w) - 1, 0)), (x, i) -> xxhash64(x, w[i + 1]))"
    first = "IF(size(w) > 0, array(xxhash64(w[0], '')), CAST(array() AS array<bigint>))"
    names = f"filter(transform(w, (x, i) -> named_struct('name', IF(contains(x, ':') OR contains(x, '='), {_name(_core('x'))}, ''), 'i', i)), y -> y.name <> '')"
    with_words = "CASE y.i WHEN 0 THEN NULL WHEN 1 THEN xxhash64(w[0], '', y.name) ELSE xxhash64(get(w, y.i - 2), get(w, y.i - 1), y.name) END"
    named = f"flatten(transform({names}, y -> filter(array(xxhash64('', y.name), {with_words}), h -> h IS NOT NULL)))"
    pairs = docs.select(F.expr(words).alias("w")).select(F.explode(F.expr(f"concat({pairs}, {first}, {named})")).alias("pair"))
    part = "split(context, ' ')"
    key = (
        f"CASE WHEN context LIKE '% ' THEN xxhash64({part}[0], {part}[1]) WHEN size({part}) = 1 THEN xxhash64('', context) "
        f"WHEN size({part}) = 2 THEN xxhash64({part}[0], '', {part}[1]) ELSE xxhash64({part}[0], {part}[1], {part}[2]) END"
    )
    keyed = written(contexts.withColumn("pair", F.expr(key)), "pii-pairs")
    byte = F.get(_flags(keyed), F.expr(f"CAST(shiftright(pair & {SLOTS - 1}L, 3) AS int)"))
    asked = pairs.where(byte.bitwiseAND(F.expr("shiftleft(1, CAST(pair & 7L AS int))")) != 0)
    counted = asked.groupBy("pair").agg(F.count("*").alias("total"))
    return keyed.join(counted, "pair", "left").select("context", F.greatest(F.coalesce("total", F.lit(0)), "led").alias("total"))


def learned(docs: DataFrame, spans: DataFrame, *, rounds: int, confidence: float, support: int) -> DataFrame:
    """``context, rank, led``: contexts that lead to identifiers of a kind, one row for each such kind, scored on the graph of contexts and instances.

    An edge is a context with an instance that it precedes, weighted by occurrences. Seeds believe in their kind. In each
    round, a context's confidence is the share of all its occurrences in the corpus, followed by an instance or by
    ordinary words, that lead to believed instances; it counts with ``support`` distinct ones and ``confidence``.
    Instances of a fitting form after such a context are believed in the next round, also behind other contexts.
    """
    base = spans.select(F.explode("base").alias("s")).select(F.explode("s.contexts").alias("context"), "s.value", "s.rank")
    other = spans.select(F.explode("other").alias("s")).select(F.explode("s.contexts").alias("context"), "s.value", F.lit(None).cast("int").alias("rank"))
    edges = base.union(other).groupBy("context", "value", "rank").agg(F.count("*").alias("n"))
    edges = written(edges, "pii-edges")
    # For no kind can a context gain support beyond its seeds of that kind and the instances of that kind's form.
    could = [F.count_if((F.col("rank") == i) | (F.col("rank").isNull() & F.col("value").rlike(FORM[k]))) for i, k in enumerate(KINDS)]
    wide = edges.groupBy("context").agg(F.greatest(*could).alias("instances"), F.sum("n").alias("led")).where(F.col("instances") >= support)
    wide = written(wide, "pii-contexts")
    totals = wide.select("context", F.col("led").alias("total"))
    if not wide.isEmpty():
        totals = context_totals(docs, wide.select("context", "led"))
    totals = written(totals, "pii-totals")
    edges = edges.join(totals.select("context"), "context", "left_semi")
    edges = written(edges, "pii-graph")
    forms = [F.col("value").rlike(FORM[k]) for k in KINDS]
    believed = edges.where("rank IS NOT NULL").select("value", "rank").distinct()
    accepted = None
    for _ in range(rounds):
        led = edges.select("context", "value", "n").join(believed, "value").groupBy("context", "rank").agg(F.sum("n").alias("led"), F.countDistinct("value").alias("instances"))
        sure = led.join(totals, "context").where((F.col("instances") >= support) & (F.col("led") >= confidence * F.col("total")))
        accepted = written(sure.select("context", "rank", "led"), "pii-accepted")
        fits = sum((F.when((F.col("rank") == i) & f, 1).otherwise(0) for i, f in enumerate(forms)), F.lit(0)) > 0
        found = edges.where("rank IS NULL").select("context", "value").join(accepted, "context").where(fits)
        # A value whose form fits several kinds of one context is of the kind that the context leads to most.
        found = found.groupBy("context", "value").agg(F.max_by("rank", F.struct("led", -F.col("rank"))).alias("rank")).select("value", "rank")
        believed = written(edges.where("rank IS NOT NULL").select("value", "rank").union(found).distinct(), "pii-believed")
    return accepted


def personal_data(docs: DataFrame, *, rounds: int = 3, confidence: float = 0.3, support: int = 5) -> DataFrame:
    """Personal data of every row: ``row, doc_id, text_hash, base, added``, arrays of ``start, rank, stop`` in code points.

    ``base`` holds the matches of the base patterns of ``KINDS`` (``rank`` is the place there), ``added`` what learned
    contexts find beside them; nothing that overlaps a base match is added. Null and empty texts have no spans.
    Repeated rows, and rows that share a doc_id, get their own equal spans. An empty table gives no row. Where no
    context is learned, nothing is added. Other columns are ignored.

    Only matches leave the scan, never texts. The graph is shuffled by context and by value, pre-aggregated; a context
    that a third of all matches share is one skewed join key, split at run time.
    """
    spans = written(located(docs), "pii-spans")
    accepted = learned(docs, spans, rounds=rounds, confidence=confidence, support=support)
    kind_fits = sum((F.when((F.col("rank") == i) & F.col("value").rlike(FORM[k]), 1).otherwise(0) for i, k in enumerate(KINDS)), F.lit(0)) > 0
    more = (
        spans.select("row", F.explode("other").alias("s"))
        .select("row", "s.*", F.explode("s.contexts").alias("context"))
        .join(accepted, "context")
        .where(kind_fits)
        .groupBy("row", "start", "stop")
        .agg(F.max_by("rank", F.struct("led", -F.col("rank"))).alias("rank"))
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("start", "rank", "stop"))).alias("added"))
    )
    bare = "transform({}, x -> named_struct('start', x.start, 'rank', x.rank, 'stop', x.stop))"
    kind = "array<struct<start:int,rank:int,stop:int>>"
    return spans.join(more, "row", "left").select("row", "doc_id", "text_hash", F.expr(bare.format("base")).cast(kind).alias("base"), F.expr(f"coalesce(added, CAST(array() AS {kind}))").alias("added"))


def listed(spans: Column | str) -> Column:
    """Spans as ``kind:start:end`` in order, comma-joined."""
    name = "element_at(array({}), x.rank + 1)".format(", ".join(f"'{k}'" for k in KINDS))
    return F.expr(f"array_join(transform({spans}, x -> concat({name}, ':', x.start, ':', x.stop)), ',')")


def redacted(docs: DataFrame, **options) -> DataFrame:
    """The documents, all columns, with every span replaced by its kind in brackets; overlapping spans become one.

    Null and empty texts stay as they are. An empty table gives no row. Columns keep their names, whatever these are.
    """
    found = personal_data(docs, **options)
    # Rows with equal ids and texts have equal spans, so one of them stands for all; clashing names are avoided by prefix.
    todo = found.where("size(base) + size(added) > 0").groupBy(F.col("doc_id").alias("pii_id"), F.col("text_hash").alias("pii_hash"))
    # Written, so that its size is known: where few rows have spans, no text is shuffled.
    todo = written(todo.agg(F.first(F.expr("array_sort(concat(base, added))")).alias("pii_spans")), "pii-todo")
    cut = (
        "aggregate(pii_spans, named_struct('at', 0, 'out', CAST(array() AS array<string>)), "
        "(a, x) -> IF(x.stop <= a.at, a, named_struct('at', x.stop, 'out', "
        "IF(x.start < a.at, a.out, concat(a.out, array(substring(text, a.at + 1, x.start - a.at), concat('[', element_at(array('email','ip','card','phone'), x.rank + 1), ']')))))), "
        "a -> concat(array_join(a.out, ''), substring(text, a.at + 1)))"
    )
    own = docs.select(*(docs[c].alias(f"doc_{i}") for i, c in enumerate(docs.columns)))
    text, key = (f"doc_{docs.columns.index(c)}" for c in ("text", "doc_id"))
    # Bits of fixed size tell most texts without spans, which then pass where they are read; only the others meet their spans.
    may_have = KeyBits(todo, "pii_hash").may_hold(F.xxhash64(text))
    joined = own.where(may_have).join(todo, F.col(key).eqNullSafe(F.col("pii_id")) & (F.xxhash64(text) == F.col("pii_hash")), "left")
    clean = F.when(F.col("pii_spans").isNull(), F.col(text)).otherwise(F.expr(cut.replace("substring(text,", f"substring({text},")))
    changed = joined.select(*((clean if c == "text" else F.col(f"doc_{i}")).alias(c) for i, c in enumerate(docs.columns)))
    return changed.union(own.where(~may_have).select(*(F.col(f"doc_{i}").alias(c) for i, c in enumerate(docs.columns))))
