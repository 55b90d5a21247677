"""Chat formatting in budgeted windows.

A conversation becomes one or more training windows of at most ``budget`` tokens of a given tokenizer. Prefix sums of the
turns' tokens choose spans that end between turns. Every window starts with the conversation's system turn, repeats the last
turns before its span as history, up to ``history`` tokens, and goes on with the span's own turns. The loss mask covers the
texts of the assistant turns of the span; repeated ones are masked out, so each assistant text is learnt once. A turn that
does not fit beside the system turn has a window with it alone and is never cut.

A turn is written ``<s>role newline text</s> newline``. Control strings inside a role or text get a backslash after their
first character (one more, if they have some), which reading takes off again, so any text comes back as it was.

Tokens are counted where the rows lie. They are summed over cells of ``CELL`` turn numbers, the cells' sums are prefix-summed
within the conversation, and prefix sums inside a cell are added. Every ``SEGMENT`` tokens of a conversation begin a new
segment, whose windows are formed by themselves, from the system turn, the few turns before it and its own; so one
conversation that holds a third of all rows is spread over many tasks, and a task holds one window at a time.

Edge cases: a null text or role is empty; a null turn comes first; rows with one turn number go by role, then text, and
repeated rows are all kept; rows with a null conversation id are one conversation; a system turn that isn't the first counts
as an ordinary turn; texts without spaces count as many tokens as the tokenizer makes of them; other columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import saved
from . import wordstream as ws

BUDGET, HISTORY = 512, 128
CELL, SEGMENT = 1024, 1 << 20
_CONTROL = re.compile(r"([<\[])(\\*)(/?(?:s>|INST\])|</?SYS>>)")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?(?:s>|INST\])|</?SYS>>)")
_TURN = re.compile(r"<s>([^\n]*)\n(.*?)</s>\n", re.DOTALL)
_WINDOWS = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("n_repeated", pa.int64()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
WINDOW_TYPE = "conv_id long, window long, text string, n_repeated long, loss array<struct<start:long,end:long>>"
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as written, and where its text lies in it."""
    head, body = f"<s>{escape_role(role)}\n", escape(text)
    return f"{head}{body}</s>\n", len(head), len(head) + len(body)


def read_turns(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            raise ValueError("the window has text outside its turns")
        at = m.end()
        out.append((unescape_role(m[1]), unescape(m[2])))
    if at != len(text):
        raise ValueError("the window has text outside its turns")
    return out


_tokenizers: dict = {}


def token_counts(texts: list[str], tokenizer: str) -> list[int]:
    """Tokens of each text, one at least; ``tokenizer`` is the path of a vocabulary."""
    if tokenizer not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[tokenizer] = Tokenizer.from_file(tokenizer)
    return [max(1, len(found.ids)) for found in _tokenizers[tokenizer].encode_batch(texts, add_special_tokens=False)]


def _tokens(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = [write_turn(role or "", text or "")[0] for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(token_counts(turns, tokenizer), pa.int64())], [*batch.schema.names, "tokens"])

    return run


class _Segment:
    """Forms the windows of a segment. ``sums[i]`` are the tokens before ``turns[i]``, history and span alike."""

    def __init__(self, conv_id: int | None, number: int, budget: int, history: int) -> None:
        self.conv_id, self.number, self.budget, self.history = conv_id, number, budget, history
        self.system, self.turns, self.sums, self.begin, self.windows, self.system_is_own = None, [], [0], 0, 0, False

    def _push(self, turn: tuple, tokens: int) -> None:
        self.turns.append(turn)
        self.sums.append(self.sums[-1] + tokens)

    def lead(self, role: str, text: str, tokens: int, is_system: bool) -> None:
        """A turn before the segment."""
        if is_system:
            self.system = (*write_turn(role, text), False, tokens)
        else:
            self._push((*write_turn(role, text), role == "assistant", tokens), tokens)
            self.begin = len(self.turns)

    def add(self, role: str, text: str, tokens: int, is_first: bool) -> Iterator[tuple]:
        turn = (*write_turn(role, text), role == "assistant", tokens)
        beside = self.system[4] if self.system and not self.system_is_own else 0
        if self.begin < len(self.turns) and self.sums[-1] - self.sums[0] + tokens + beside > self.budget:
            yield self.close()
            beside = self.system[4] if self.system else 0
        if self.begin == len(self.turns):
            room = min(self.history, max(0, self.budget - tokens - beside))
            drop = bisect_left(self.sums, self.sums[-1] - room)
            del self.turns[:drop], self.sums[:drop]
            self.begin -= drop
        if is_first and role == "system":
            self.system, self.system_is_own = turn, True
        self._push(turn, tokens)

    def close(self) -> tuple:
        repeated = [*([self.system] if self.system and not self.system_is_own else []), *self.turns[: self.begin]]
        text, loss, at = [], [], 0
        for i, (turn, start, end, target, _) in enumerate([*repeated, *self.turns[self.begin :]]):
            if target and i >= len(repeated):
                loss.append({"start": at + start, "end": at + end})
            text.append(turn)
            at += len(turn)
        row = (self.conv_id, (self.number << 32) + self.windows, "".join(text), len(repeated), loss)
        if self.system_is_own:  # it leads later windows and is no history
            del self.turns[0], self.sums[0]
            self.system_is_own = False
        drop = bisect_left(self.sums, self.sums[-1] - self.history)
        del self.turns[:drop], self.sums[:drop]
        self.begin, self.windows = len(self.turns), self.windows + 1
        return row


def _format(budget: int, history: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, size = None, [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _WINDOWS, strict=True)], schema=_WINDOWS)

        for batch in batches:
            for conv_id, segment, is_lead, before, tokens, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "is_lead", "before", "tokens", "role", "text")), strict=True):
                role, text = role or "", text or ""
                if now is None or (conv_id, segment) != (now.conv_id, now.number):
                    if now is not None and now.begin < len(now.turns):
                        out.append(now.close())
                    now = _Segment(conv_id, segment, budget, history)
                if is_lead:
                    now.lead(role, text, tokens, before == 0 and role == "system")
                else:
                    out.extend(now.add(role, text, tokens, before == 0))
                size += len(text)
                if size >= ws.SLICE and out:
                    yield flush()
                    out.clear()
                    size = 0
        if now is not None and now.begin < len(now.turns):
            out.append(now.close())
        if out:
            yield flush()

    return run


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state, out, begun = None, None, [], False

    def end() -> tuple:
        n, turns, chars, loss, formatted = state
        return now, n, turns.hexdigest(), chars, loss.hexdigest(), formatted

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _DIGEST, strict=True)], schema=_DIGEST)

    for batch in batches:
        for conv_id, text, repeated, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "n_repeated", "loss")), strict=True):
            if not begun or conv_id != now:
                if begun:
                    out.append(end())
                now, state, begun = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], True
            for role, said in read_turns(text)[repeated:]:
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            for part in loss:
                said = unescape(text[part["start"] : part["end"]])
                state[2] += len(said)
                state[3].update(said.encode("utf-8", "surrogatepass"))
            state[4] += len(text)
        if out:
            yield flush()
            out.clear()
    if begun:
        out.append(end())
        yield flush()


def format_conversations(turns: DataFrame, tokenizer: str, budget: int = BUDGET, history: int = HISTORY, segment: int = SEGMENT) -> DataFrame:
    """``conv_id, window, text, n_repeated, loss``: windows of text (numbers rise within a conversation), how many of their
    first turns are repeated, and the spans of code points that carry loss. ``tokenizer`` is the path of a vocabulary."""
    spark = turns.sparkSession
    ws.tune(spark)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    counted = saved(rows.mapInArrow(_tokens(tokenizer), "conv_id long, turn long, role string, text string, tokens long").withColumn("cell", F.floor(F.col("turn") / CELL)), "turns")
    by_cell = Window.partitionBy("conv_id").orderBy(F.col("cell").asc_nulls_first())
    cells = counted.groupBy("conv_id", "cell").agg(F.sum("tokens").alias("held"))
    ahead = cells.select(F.col("conv_id").alias("_conv"), F.col("cell").alias("_cell"), F.coalesce(F.sum("held").over(by_cell.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"), F.sum("held").over(Window.partitionBy("conv_id")).alias("total"))
    inside = Window.partitionBy("conv_id", "cell").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.join(ahead, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("cell").eqNullSafe(F.col("_cell")))
    placed = placed.withColumn("before", F.col("ahead") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    own, last = F.floor(F.col("before") / segment), F.floor((F.col("total") - 1) / segment)
    copies = (
        F.when((F.col("before") == 0) & (F.col("role") == "system"), F.sequence(F.lit(0).cast("long"), last))
        .when((own < last) & (F.col("before") >= (own + 1) * segment - history), F.array(own, own + 1)).otherwise(F.array(own))
    )
    dealt = placed.withColumn("_own", own).withColumn("segment", F.explode(copies)).withColumn("is_lead", F.col("segment") != F.col("_own"))
    met = dealt.select("conv_id", "segment", "is_lead", "before", "tokens", "role", "text").repartition(ws.shuffle_width(spark), "conv_id", "segment")
    return met.sortWithinPartitions("conv_id", "segment", "before").mapInArrow(_format(budget, history), WINDOW_TYPE)


def read_back(windows: DataFrame) -> DataFrame:
    """One row per conversation, from the windows alone: its turns and the text under the loss mask, as digests.

    A digest is taken in order, so a conversation's windows stream through one task."""
    spark = windows.sparkSession
    ordered = windows.repartition(ws.shuffle_width(spark), "conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
