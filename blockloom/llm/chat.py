"""Preference formatting: a shared prompt, and two completions with masks.

Chosen and rejected conversations of a pair are compared turn by turn. The
longest common prefix of turns is rendered once, as the prompt; what follows
it in either conversation is a completion. Training counts only what an
assistant says in a completion: its ``target`` span.

Rendered conversations leave as one row per turn with its place, never as one
collected value, so a conversation of any length is no task's burden.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import only

#: How a turn is framed.
OPEN, BREAK, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED_ROLE = "assistant"
#: Turns of one step of a running sum; longer conversations take several steps.
SPAN = 1024


def _said() -> Column:
    return F.struct(F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _placed(rows: DataFrame, pair: str) -> DataFrame:
    """``pair_id, span, turn, role, text`` of the rows that have a place."""
    placed = only(rows, pair, "turn", "role", "text").withColumnRenamed(pair, "pair_id").where("pair_id is not null and turn is not null")
    # What joins by span infer is said here, so that all branches of a plan can share one exchange.
    return placed.select("pair_id", F.floor(F.col("turn") / SPAN).alias("span"), "turn", "role", "text").where("span is not null")


def rendered(said: str, shown: Callable[[Column], Column] | None = None) -> Column:
    """``struct<role, shown, n_chars>`` of a role and text, or null without them.

    ``shown`` makes of the rendered turn what is carried on in its place, such
    as a digest; by default it is carried as it is.
    """
    role = F.col(f"{said}.role")
    text = F.concat(F.lit(OPEN), role, F.lit(BREAK), F.col(f"{said}.text"), F.lit(CLOSE))
    return F.when(F.col(said).isNotNull(), F.struct(role.alias("role"), (shown(text) if shown else text).alias("shown"), F.char_length(text).cast("bigint").alias("n_chars")))


def both_sides(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id", shown: Callable[[Column], Column] | None = None) -> DataFrame:
    """``pair_id, span, turn, c, r``: each side's rendered turn, null where it has none.

    Texts are exchanged once, by span of turns, which is how segments need
    them. Rows without a pair or a turn number have no place and are left out;
    of several rows for a turn the least (role, text) holds; a null role is
    ``unknown`` and a null text empty.
    """
    return _matched(_placed(chosen, pair), _placed(rejected, pair), shown)


def _matched(chosen: DataFrame, rejected: DataFrame, shown: Callable[[Column], Column] | None) -> DataFrame:
    """``both_sides`` of tables from ``_placed``; where both come dealt by pair and span, nothing is exchanged."""
    none = F.lit(None).cast("struct<role:string,text:string>")
    every = chosen.select("pair_id", "span", "turn", _said().alias("c"), none.alias("r"))
    every = every.unionByName(rejected.select("pair_id", "span", "turn", none.alias("c"), _said().alias("r")))
    both = every.repartition("pair_id", "span").groupBy("pair_id", "span", "turn").agg(F.min("c").alias("c"), F.min("r").alias("r"))
    return both.select("pair_id", "span", "turn", rendered("c", shown).alias("c"), rendered("r", shown).alias("r"))


def segments_of(both: DataFrame) -> DataFrame:
    """The segments of pairs that ``both_sides`` or ``other_answers`` gives; see ``preference_segments``.

    Where the first turn differs and where each span of turns starts is found
    from the turns' lengths alone; what is rendered then moves once, to its span.
    """
    def side(name: str) -> list[Column]:
        return [F.col(f"{name}.role").alias(f"{name}_role"), F.col(f"{name}.shown").alias(f"{name}_shown"), F.col(f"{name}.n_chars").alias(f"{name}_n")]

    rows = both.select("pair_id", "turn", "span", (~F.col("c").eqNullSafe(F.col("r"))).alias("differs"), *side("c"), *side("r"))
    # The pair's first turn that differs; no row of it means that none does.
    first = rows.where("differs").groupBy("pair_id").agg(F.min("turn").alias("first"))
    same = F.col("first").isNull() | (F.col("turn") < F.col("first"))
    lengths = {"prompt": F.when(same, F.col("c_n")), "chosen": F.when(~same, F.col("c_n")), "rejected": F.when(~same, F.col("r_n"))}
    spans = rows.select("pair_id", "turn", "span", "c_n", "r_n").join(first, "pair_id", "left")
    spans = spans.groupBy("pair_id", "span").agg(F.min("first").alias("first"), *[F.sum(n).alias(part) for part, n in lengths.items()])
    before = W.partitionBy("pair_id").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.select("pair_id", "span", "first", *[F.coalesce(F.sum(part).over(before), F.lit(0)).alias(part) for part in lengths])
    within = W.partitionBy("pair_id", "span").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.join(spans, ["pair_id", "span"])
    starts = {part: (F.col(part) + F.coalesce(F.sum(n).over(within), F.lit(0))).alias(f"{part}_start") for part, n in lengths.items()}
    placed = placed.select("pair_id", "turn", same.alias("same"), *[f"{s}_{c}" for s in "cr" for c in ("role", "shown", "n")], *starts.values())

    def piece(part: str, name: str) -> Column:
        role, n, start = F.col(f"{name}_role"), F.col(f"{name}_n"), F.col(f"{part}_start")
        trained = (role == TRAINED_ROLE) & F.lit(part != "prompt")
        head = F.char_length(role) + len(OPEN) + len(BREAK)
        return F.struct(
            F.lit(part).alias("part"), role.alias("role"), F.col(f"{name}_shown").alias("rendered"), start.alias("start"), n.alias("n_chars"),
            F.when(trained, start + head).alias("target_start"), F.when(trained, start + n).alias("target_end"),
        )

    parts = F.when(F.col("same"), F.array(piece("prompt", "c"))).otherwise(F.filter(F.array(piece("chosen", "c"), piece("rejected", "r")), lambda p: p["role"].isNotNull()))
    return placed.select("pair_id", "turn", F.explode(parts).alias("p")).select(
        "pair_id", "p.part", "turn", *[f"p.{c}" for c in ("role", "rendered", "start", "n_chars", "target_start", "target_end")]
    )


def preference_segments(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id") -> DataFrame:
    """The rendered turns of every pair.

    ``pair_id, part, turn, role, rendered, start, n_chars, target_start,
    target_end``: ``part`` is prompt, chosen or rejected, ``start`` the
    rendered turn's first character within its part, and the target span (of
    characters within the part, null if masked) is an assistant's text and
    closing mark in a completion. Turns are equal if number, role and text are.

    A pair that only one side knows has an empty prompt and one completion;
    equal conversations are all prompt. Empty tables give no rows; other
    columns, whatever their names, are ignored; see ``both_sides`` for nulls
    and repeated turns. Long texts are turns like others.
    """
    return segments_of(both_sides(chosen, rejected, pair))


def paired(segments: DataFrame) -> DataFrame:
    """One row for each pair, of any length: what its prompt and its two masked completions hold, without collecting them.

    ``pair_id``; for each part ``<part>_turns``, ``<part>_chars`` and
    ``<part>_digest``, which folds every turn's ``rendered`` and place; for the
    completions ``<part>_target_chars``, the characters that are trained on;
    and ``mask_digest``, which folds their spans. All are sums, so nothing but
    numbers is exchanged.
    """
    def word(*what: Column) -> Column:
        text = F.concat_ws(":", *[w.cast("string") for w in what])
        return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")

    turn = word(F.col("turn"), F.col("start"), F.col("n_chars"), F.col("rendered"))
    target = F.col("target_end") - F.col("target_start")
    of = lambda part, what: F.when(F.col("part") == part, what)
    number = lambda c, name: F.coalesce(c, F.lit(0)).cast("bigint").alias(name)
    sums = []
    for part in ("prompt", "chosen", "rejected"):
        sums += [F.count(of(part, F.lit(1))).alias(f"{part}_turns"), number(F.sum(of(part, F.col("n_chars"))), f"{part}_chars"), number(F.bit_xor(of(part, turn)), f"{part}_digest")]
    sums += [number(F.sum(of(part, target)), f"{part}_target_chars") for part in ("chosen", "rejected")]
    mask = F.when(target.isNotNull(), word(F.col("part"), F.col("target_start"), F.col("target_end")))
    return segments.groupBy("pair_id").agg(*sums, number(F.bit_xor(mask), "mask_digest"))


def preference_pairs(segments: DataFrame) -> DataFrame:
    """``pair_id, prompt, chosen, rejected, chosen_spans, rejected_spans``: one training example per pair.

    For conversations that fit an example; the segments serve any length.
    """
    def joined(part: str) -> Column:
        return F.concat_ws("", F.transform(F.filter("all", lambda s: s["part"] == part), lambda s: s["rendered"])).alias(part)

    def spans(part: str) -> Column:
        kept = F.filter("all", lambda s: (s["part"] == part) & s["target_start"].isNotNull())
        return F.transform(kept, lambda s: F.struct(s["target_start"].alias("from"), s["target_end"].alias("to"))).alias(f"{part}_spans")

    one = F.struct("turn", "part", "rendered", "target_start", "target_end")
    gathered = segments.groupBy("pair_id").agg(F.sort_array(F.collect_list(one)).alias("all"))
    return gathered.select("pair_id", joined("prompt"), joined("chosen"), joined("rejected"), spans("chosen"), spans("rejected"))


def other_answers(spark: SparkSession, conversations: DataFrame, shown: Callable[[Column], Column] | None = None) -> DataFrame:
    """``pair_id, span, turn, c, r``, as of ``both_sides``: each conversation, and the same with its last assistant turn answered as the next one's.

    The next conversation's number is greater by one; a conversation that no
    such one answers gets an empty text there. The rejected conversations are
    a table of whole texts, matched with the others turn by turn like any two
    tables; both come from one exchange. Nothing is written, so ``spark`` is
    kept for callers only.
    """
    clean = _placed(conversations, "conv_id").repartition("pair_id", "span").groupBy("pair_id", "span", "turn").agg(F.min(_said()).alias("said"))
    clean = clean.select("pair_id", "span", "turn", "said.role", "said.text")
    last = clean.where(F.col("role") == TRAINED_ROLE).groupBy("pair_id").agg(F.max_by("text", "turn").alias("answer"), F.max(F.struct("turn", "span")).alias("at"))
    # No number is greater than the greatest: null, which answers nobody.
    asked = last.select("pair_id", "at", F.try_add("pair_id", F.lit(1)).alias("next"))
    answers = last.select(F.col("pair_id").alias("next"), "answer")
    swapped = asked.join(answers, "next", "left").select("pair_id", "at.span", F.col("at.turn").alias("last"), F.coalesce("answer", F.lit("")).alias("answer"))
    other = F.when(F.col("turn") == F.col("last"), F.col("answer")).otherwise(F.col("text"))
    rejected = clean.join(swapped, ["pair_id", "span"], "left").select("pair_id", "span", "turn", "role", other.alias("text"))
    return _matched(clean, rejected, shown)
