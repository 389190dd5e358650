"""Personal data by base patterns and bootstrapped contexts, in DataFrame functions only.

Base entities (e-mail, IP address, payment card, telephone) are found by their patterns in every whole
text.  They seed a graph between left contexts and identifier-like candidates of the corpus, each one token or
neighbouring tokens of one identifier; those of a list have the context of the list.  A context is as
trustworthy for a kind as the share of its tokens that are of this kind, an unknown token is as likely of
a kind as its contexts are trustworthy.  Both are computed in turn from joins and aggregates.  Unknown
tokens in contexts of high confidence with enough different entities are reported too.

Patterns are written with possessive repetition and starts bound to the beginning of a run, which finds
the same leftmost matches in linear time and without deep recursion in texts of any length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import kept_table, ready

KINDS = ("email", "ip", "card", "phone")
# the leftmost match of a run starts at its beginning or where the match before ended
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
# a token with a digit or an at sign
IDENTIFIER = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
CONTEXT_CHARS = 64
FOLD_BLOCK = 256
SPAN = "array<struct<start:int,stop:int,value:string,context:string,link:string>>"
# the last token of the text between two identifiers that is more than a separator of a list
LEFT = r"(?<!\S)([,;]*+[^\s,;]\S*+)(?:\s++[,;]++(?!\S))*+\s*+$"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once and not at every mention."""
    return F.transform(F.array(value), body)[0]


def matches(text: Column, pattern: str) -> Column:
    """Non-overlapping matches as structs: start and stop in code points, value, context, link.

    The context is the token to the left.  A match that follows another one with nothing but blanks or list
    separators between them has the context of that one, or that one itself when it ends as a label does
    (``:`` or ``=``).  ``link`` has the blanks to the match before when both can be parts of one identifier.
    Positions follow from the lengths of the matches and of the text between them.
    """

    def step(both: Column, acc: Column, i: Column) -> Column:
        gap, value = F.get(both["gaps"], i), F.get(both["found"], i)
        start = acc["at"] + F.length(gap)
        stop = start + F.length(value)
        end = F.right(acc["last"], F.lit(1))

        def rows(left: Column) -> Column:
            token = F.when(left == "", F.when(end.isin(":", "="), acc["last"])).otherwise(left)
            context = F.coalesce(F.lower(F.right(token, F.lit(CONTEXT_CHARS))), acc["context"])
            link = F.when((acc["last"] != "") & ~end.isin(",", ";", ":", "=") & gap.rlike(r"^[ \t]+$"), gap)
            row = F.struct(start.alias("start"), stop.alias("stop"), value.alias("value"), context.alias("context"), link.alias("link"))
            return F.concat(acc["rows"], F.array(row))

        more = bound(F.regexp_extract(gap, LEFT, 1), rows)
        return bound(
            more,
            lambda r: F.struct(stop.alias("at"), F.element_at(r, -1)["context"].alias("context"), value.alias("last"), r.alias("rows")),
        )

    def block(both: Column, state: Column, number: Column) -> Column:
        last = F.least((number + 1) * FOLD_BLOCK, F.size(both["found"])) - 1
        empty = F.struct(state["at"].alias("at"), state["context"].alias("context"), state["last"].alias("last"), F.array().cast(SPAN).alias("rows"))
        return F.aggregate(F.sequence(number * FOLD_BLOCK, last), empty, lambda acc, i: step(both, acc, i))

    def folded(both: Column) -> Column:
        # blocks keep the appending of rows near linear in texts with very many matches
        none = F.lit("")
        empty = F.struct(F.lit(0).alias("at"), none.alias("context"), none.alias("last"), F.array().cast(f"array<{SPAN}>").alias("blocks"))
        numbers = F.sequence(F.lit(0), ((F.size(both["found"]) - 1) / FOLD_BLOCK).cast("int"))
        more = lambda acc, i: bound(
            block(both, acc, i),
            lambda r: F.struct(r["at"].alias("at"), r["context"].alias("context"), r["last"].alias("last"), F.concat(acc["blocks"], F.array(r["rows"])).alias("blocks")),
        )
        return F.when(F.size(both["found"]) == 0, F.array().cast(SPAN)).otherwise(
            F.aggregate(numbers, empty, more, lambda acc: F.flatten(acc["blocks"]))
        )

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return bound(F.struct(F.split(text, pattern, -1).alias("gaps"), found.alias("found")), folded)


def _in_context(spans: Column, tokens: Column) -> Column:
    """Spans with the context of the token they begin in, or with what this token has before them."""

    def token_of(s: Column) -> Column:
        # the last token that starts at or before the span, by halving
        def half(acc: Column, _: Column) -> Column:
            middle = ((acc["lo"] + acc["hi"] + 1) / 2).cast("int")
            before = F.get(tokens, middle)["start"] <= s["start"]
            return F.struct(
                F.when(before, middle).otherwise(acc["lo"]).alias("lo"),
                F.when(before, acc["hi"]).otherwise(F.greatest(acc["lo"], middle - 1)).alias("hi"),
            )

        whole = F.struct(F.lit(0).alias("lo"), (F.size(tokens) - 1).alias("hi"))
        steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(tokens) + 1)).cast("int"))
        return F.get(tokens, F.aggregate(steps, whole, half, lambda acc: acc["lo"]))

    def context(s: Column, token: Column) -> Column:
        head = F.substring(token["value"], F.lit(1), s["start"] - token["start"])
        label = head.rlike(r"[:=]$") | (head.rlike(r"\p{L}") & ~head.rlike("[0-9@]"))
        return F.when(label, F.lower(F.right(head, F.lit(CONTEXT_CHARS)))).otherwise(token["context"])

    def row(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value"), bound(token_of(s), lambda t: context(s, t)).alias("context"))

    return F.transform(spans, row)


def _joined(tokens: Column) -> Column:
    """Tokens with those of one identifier joined: neighbours with nothing but blanks between them."""

    def begins(rows: Column, i: Column) -> Column:
        row = F.get(rows, i)
        return (i == 0) | row["link"].isNull() | (F.get(rows, i - 1)["stop"] + F.length(row["link"]) != row["start"])

    def run(rows: Column, first: Column, n: Column) -> Column:
        head = F.get(rows, first)
        more = F.transform(F.slice(rows, first + 2, n - 1), lambda t: F.concat(t["link"], t["value"]))
        value = F.concat(head["value"], F.array_join(more, ""))
        return F.struct(head["start"].alias("start"), F.get(rows, first + n - 1)["stop"].alias("stop"), value.alias("value"), head["context"].alias("context"))

    def runs(rows: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda i: begins(rows, i))
        return bound(firsts, lambda f: F.transform(f, lambda x, k: run(rows, x, F.coalesce(F.get(f, k + 1), F.size(rows)) - x)))

    none = F.array().cast("array<struct<start:int,stop:int,value:string,context:string>>")
    return bound(tokens, lambda rows: F.when(F.size(rows) == 0, none).otherwise(runs(rows)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def term(i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(i % 2 == 0, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    numbers = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(numbers, F.lit(0), lambda total, i: total + term(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.length(n := F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.coalesce(n.try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(value, r"\."), part)
    if kind == "card":
        return bound(_digits(value), lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Valid matches of one kind; a failing match is dropped and not tried again from within."""
    hint = HINTS[kind]
    likely = text.rlike("[0-9]") if kind != "email" else F.lit(True)
    likely = likely & text.contains(hint) if hint else likely
    return F.when(likely, F.filter(matches(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))).otherwise(F.array().cast(SPAN))


def found_entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a row number, the base spans of each kind, and candidates like identifiers outside of them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = ready(docs).withColumns({"_row": F.monotonically_increasing_id(), "_text": text})
    tokens = F.when(F.col("_text").rlike("[0-9@]"), matches(F.col("_text"), IDENTIFIER)).otherwise(F.array().cast(SPAN))
    out = out.withColumn("_tokens", tokens)
    out = out.withColumns({f"_{kind}": _in_context(base_spans(F.col("_text"), kind), F.col("_tokens")) for kind in KINDS})
    base = F.concat(*(F.col(f"_{kind}") for kind in KINDS))
    outside = F.filter(
        F.col("_tokens"), lambda t: ~F.exists(base, lambda s: (s["start"] < t["stop"]) & (t["start"] < s["stop"]))
    )
    return out.withColumn("_tokens", _joined(outside)).drop("_text")


def _occurrences(found: DataFrame) -> DataFrame:
    """(context, value, n, kind): how often each value stands in each context; kind is null for unknown tokens."""

    def of(kind: str | None) -> Callable[[Column], Column]:
        return lambda s: F.struct(
            s["context"].alias("context"), s["value"].alias("value"), F.lit(kind).cast("string").alias("kind")
        )

    kinds = [F.transform(f"_{k}", of(k)) for k in KINDS]
    unknown = F.transform("_tokens", of(None))
    rows = found.select(F.explode(F.concat(*kinds, unknown)).alias("s")).select("s.*").where("context <> ''")
    return rows.groupBy("context", "value", "kind").agg(F.count("*").alias("n"))


def learn_contexts(found: DataFrame, rounds: int = 2, min_score: float = 0.8, min_entities: int = 5) -> DataFrame:
    """(context, kind): contexts of high confidence after ``rounds`` of scoring.

    Score of a context for a kind: weight of its tokens of this kind over the weight of all its tokens
    plus one.  Score of an unknown token: mean of the scores of its contexts, by occurrences.  A context
    needs ``min_entities`` different tokens that are of the kind, known or scored ``min_score``.
    """
    edges = kept_table(_occurrences(found), "pii-graph")
    known = edges.where("kind IS NOT NULL").groupBy("context").agg(
        F.sum("n").alias("known"),
        *(F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"w_{k}") for k in KINDS),
        *(F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(f"d_{k}") for k in KINDS),
    )
    unknown = edges.where("kind IS NULL").select("context", "value", "n")
    values = None
    for i in range(rounds):
        scored = unknown if values is None else unknown.join(values, "value")
        score = {k: F.lit(0.0) if values is None else F.col(f"s_{k}") for k in KINDS}
        added = scored.groupBy("context").agg(
            F.sum("n").alias("more"),
            *(F.sum(F.col("n") * score[k]).alias(f"a_{k}") for k in KINDS),
            *(F.sum(F.when(score[k] >= min_score, 1).otherwise(0)).alias(f"e_{k}") for k in KINDS),
        )
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        contexts = known.join(added, "context", "full").select(
            "context",
            *(((zero(f"w_{k}") + zero(f"a_{k}")) / (zero("known") + zero("more") + 1)).alias(f"p_{k}") for k in KINDS),
            *((zero(f"d_{k}") + zero(f"e_{k}")).alias(f"n_{k}") for k in KINDS),
        )
        contexts = kept_table(contexts, "pii-contexts")
        if i + 1 < rounds:
            near = unknown.join(contexts, "context").groupBy("value")
            values = near.agg(*((F.sum(F.col("n") * F.col(f"p_{k}")) / F.sum("n")).alias(f"s_{k}") for k in KINDS))
            values = kept_table(values, "pii-values")
    sure = [F.when((F.col(f"p_{k}") >= min_score) & (F.col(f"n_{k}") >= min_entities), F.lit(k)) for k in KINDS]
    return contexts.select("context", F.coalesce(*sure).alias("kind")).where("kind IS NOT NULL")


def _trimmed(span: Column, kind: Column) -> Column:
    """The candidate without punctuation around it; a parenthesis that closes before its last letter or digit stays."""
    value = span["value"]
    lead = F.length(value) - F.length(F.regexp_replace(value, r"(?s)^(?:(?!\([^()]*+\).*[\p{L}\p{N}])[^\p{L}\p{N}@+])++", ""))
    kept = F.length(F.regexp_extract(value, r"(?s)^(.*[\p{L}\p{N}])", 1))
    return F.struct(kind.alias("kind"), (span["start"] + lead).alias("start"), (span["start"] + F.greatest(kept, lead)).alias("stop"))


def personal_data(docs: DataFrame, text_col: str = "text", keep_text: bool = True, **options) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (kind, start, stop), stop exclusive, in code points.

    ``base`` has the valid base matches by kind in order of KINDS, then start; ``spans`` also has what the
    contexts add, in the same order.  A null text is empty.  Rows are kept as they are, repeated ones too;
    columns named ``base`` or ``spans`` are replaced.  ``keep_text=False`` leaves the text out.
    """
    found = found_entities(docs.drop("base", "spans"), text_col)
    found = kept_table(found if keep_text else found.drop(text_col), "pii")
    contexts = learn_contexts(found, **options)
    tokens = found.select("_row", F.explode("_tokens").alias("t"))
    named = tokens.join(contexts, F.col("t.context") == F.col("context"))
    new = named.select("_row", _trimmed(F.col("t"), F.col("kind")).alias("s")).where("s.stop > s.start")
    new = new.groupBy("_row").agg(F.collect_list("s").alias("_new"))  # tokens of one text

    def of(kind: str) -> Callable[[Column], Column]:
        return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))

    every = [F.transform(f"_{k}", of(k)) for k in KINDS]
    out = found.join(new, "_row", "left").withColumn("base", F.concat(*every))
    none = F.array().cast("array<struct<kind:string,start:int,stop:int>>")
    place = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    keyed = F.transform(F.concat("base", F.coalesce("_new", none)), lambda s: F.struct(place(s).alias("k"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    ordered = F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    out = out.withColumn("spans", F.when(F.col("_new").isNull(), F.col("base")).otherwise(ordered))
    return out.drop("_row", "_tokens", "_new", *(f"_{k}" for k in KINDS))


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(
            F.greatest(acc["at"], s["stop"]).alias("at"), F.when(s["start"] >= acc["at"], piece).otherwise(acc["out"]).alias("out")
        )

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(by_start, empty, step, rest))
