"""Chat formatting by quotation linking.

A line's quote level is its number of leading ``>``. A maximal run of lines of
one level is a quoted passage; it and each of its lines are normalised (case
and white space) and hashed, and so are every message's own lines, paragraphs
and body, at every level. Hashes meet in a join within the conversation; the
original of a hash is the first message that says it, and a quote is linked if
that message came before. All levels are linked: a message replies to the
original from which most quoted characters of its lowest linked level come
(ties: the later message), and ``quoted`` lists the originals of every level, so
a quotation whose nearest level was trimmed or rewritten still finds the message
quoted in it. Replies follow the message they quote: rows sort by conv_id,
root_turn, turn, where root_turn is the turn at the head of the quotation chain.

Only linked lines leave the text, with the empty quoted lines beside them; what
merely looks like a quotation (a prompt, a quoted passage from elsewhere) stays.

The join's right side has one row for each conversation and hash, and chains
are followed by doubling on unique keys, so neither a long conversation nor a
common phrase gathers in one task.

Defined results: null texts become empty ones; a message without quotes, or
whose quotes have no earlier original, has reply_to null and is its own root;
rows with a null conv_id or turn are kept and never linked; conv_id may be of
any type that prints as text, and turn is a whole number; rows equal in conv_id
and turn are formatted each for itself and, as originals, count as one; a turn
does not quote itself; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, small_batches

_QUOTE = re.compile(r"^[ \t]*((?:>[ \t]?)+)(.*)$", re.S)
_SPACE = re.compile(r"\s+")
PARSED = (
    "conv_id string, turn string, role string, th long, text string, own array<string>, "
    "quotes array<struct<level: int, hash: string, weight: int, lines: array<int>>>, n_quotes long"
)


def normalised(text: str) -> str:
    return _SPACE.sub(" ", text).strip().lower()


def digest(text: str) -> str | None:
    """128 bits of a normalised passage; none for one without text."""
    text = normalised(text)
    return hashlib.blake2b(text.encode(), digest_size=16).hexdigest() if text else None


def runs_of(text: str | None) -> list[tuple[int, list[tuple[int, str]]]]:
    """Maximal runs of lines of one quote level: the level, and each line's number and what follows its marks."""
    runs: list[tuple[int, list[tuple[int, str]]]] = []
    for i, line in enumerate((text or "").split("\n")):
        m = _QUOTE.match(line)
        level, rest = (m[1].count(">"), m[2]) if m else (0, line)
        if not runs or runs[-1][0] != level:
            runs.append((level, []))
        runs[-1][1].append((i, rest))
    return runs


def parse(text: str | None) -> tuple[list[str], list[dict], int]:
    """The hashes a message may be quoted by, its quotes (level, hash, characters, lines that go if it is linked), and its number of
    quoted passages. Empty quoted lines go with the line before them in their passage, else with the one after."""
    runs, own, quotes = runs_of(text), set(), []
    own.add(digest("\n".join(rest for level, lines in runs if not level for _, rest in lines)))
    for level, lines in runs:
        whole = "\n".join(rest for _, rest in lines)
        own.update(map(digest, [whole, *re.split(r"\n[ \t]*\n", whole), *(rest for _, rest in lines)]))
        if level and digest(whole):
            full = [k for k, (_, rest) in enumerate(lines) if rest.strip()]
            edges = [0, *full[1:], len(lines)]
            parts = [(lines[k][1], [i for i, _ in lines[x:y]]) for k, x, y in zip(full, edges, edges[1:], strict=False)]
            if len(parts) > 1:
                parts.append((whole, [i for i, _ in lines]))
            quotes += [{"level": level, "hash": digest(t), "weight": len(normalised(t)), "lines": at} for t, at in parts]
    return sorted(d for d in own if d), quotes, sum(level > 0 for level, _ in runs)


def parse_messages(messages: DataFrame) -> DataFrame:
    """conv_id and turn as strings, so that none is changed on its way through pandas."""
    small_batches(messages.sparkSession)
    source = messages.select(F.col("conv_id").cast("string"), F.col("turn").cast("long").cast("string"), F.col("role").cast("string"), F.xxhash64("text").alias("th"), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [parse(t) for t in batch["text"]]
            out = batch[["conv_id", "turn", "role", "th"]].copy()
            out["text"] = batch["text"].map(lambda t: t or "")
            out["own"], out["quotes"], out["n_quotes"] = [x[0] for x in got], [x[1] for x in got], [x[2] for x in got]
            yield out

    return source.mapInPandas(run, PARSED).withColumn("turn", F.col("turn").cast("long"))


def _roots(links: DataFrame) -> DataFrame:
    """(conv_id, turn, root, depth) of messages that reply, by doubling; each step halves the longest chain."""
    up = checkpoint(links.select("conv_id", "turn", F.col("reply_to").alias("root"), F.lit(1).alias("depth")))
    while True:
        right = up.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("root").alias("_r"), F.col("depth").alias("_d"))
        step = up.join(right, (F.col("conv_id") == F.col("_c")) & (F.col("root") == F.col("_t")), "left")
        step = checkpoint(step.select("conv_id", "turn", F.coalesce("_r", "root").alias("root"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"), F.col("_r").isNotNull().alias("moved")))
        up = step.drop("moved")
        if step.filter("moved").isEmpty():
            return up


def format_conversations(messages: DataFrame) -> DataFrame:
    """conv_id, root_turn, turn, role, reply_to, depth, n_quotes (passages), n_linked (linked lines and passages), quoted (level:turn of
    all originals, comma-joined) and text without linked quotes; sort by the first three for reading order."""
    parsed = checkpoint(parse_messages(messages))
    first = parsed.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    quotes = first.select("conv_id", "turn", "th", F.explode("quotes").alias("q")).select("conv_id", "turn", "th", "q.*")
    said = first.select("conv_id", "turn", F.explode("own").alias("hash")).groupBy("conv_id", "hash").agg(F.min("turn").alias("said_at"))
    linked = checkpoint(quotes.join(said, ["conv_id", "hash"]).filter(F.col("said_at") < F.col("turn")))
    key = ["conv_id", "turn", "th"]
    votes = linked.groupBy(*key, "level", "said_at").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"), F.flatten(F.collect_set("lines")).alias("lines"))
    best = F.max(F.struct(-F.col("level"), "weight", "said_at"))["said_at"]
    quoted = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("level", "said_at"))), lambda x: F.concat_ws(":", x["level"], x["said_at"])), ",")
    links = checkpoint(votes.groupBy(*key).agg(best.alias("reply_to"), F.sum("n").alias("n_linked"), quoted.alias("quoted"), F.array_distinct(F.flatten(F.collect_list("lines"))).alias("cut")))
    roots = _roots(links.groupBy("conv_id", "turn").agg(F.min("reply_to").alias("reply_to")))
    got = parsed.join(links, key, "left").join(roots, ["conv_id", "turn"], "left")
    left = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("cut", i))
    text = F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return got.select(
        F.col("conv_id").cast(messages.schema["conv_id"].dataType).alias("conv_id"), F.coalesce("root", "turn").alias("root_turn"), "turn", "role", "reply_to",
        F.coalesce("depth", F.lit(0)).alias("depth"), "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.coalesce("quoted", F.lit("")).alias("quoted"), text.alias("text"),
    )


def write_conversations(messages: DataFrame, path: str, files: int) -> None:
    """Files in reading order over all conversations; a long conversation may span files."""
    got = format_conversations(messages)
    got.repartitionByRange(files, "conv_id", "root_turn", "turn").sortWithinPartitions("conv_id", "root_turn", "turn").write.parquet(path)
