"""Action streams: chunks that overlap in time are blended into one stream of actions.

``blend_chunks`` is the batch twin over stored chunks; ``ActionStream`` is the rule itself, for one
stream at a time; ``blend_stream`` runs it over a streaming table with keyed state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strideframe.operators.frames import KEY, ORDER

#: Fixed values of the stream: actions of a chunk that are used, and actions that a blend spans at least.
USED, LEAST = 30, 8
HANDS = slice(16, 18)


def broker(steps: DataFrame, horizon: int) -> DataFrame:
    """Which chunk serves a step, and from which place: a new chunk when the old one is exhausted."""
    return steps.withColumn("chunk", F.floor(F.col(ORDER) / horizon)).withColumn("j", F.col(ORDER) % horizon)


def blend_chunks(chunks: DataFrame, value: str, consumed: int, least: int = LEAST) -> DataFrame:
    """blended: rows (episode, chunk, j, value) where ``consumed`` actions of a chunk run before the next one arrives.

    What is pending of the old chunk is repeated at its end up to ``least`` actions, cut to the new one, and
    fades out linearly. Without anything pending the new chunk stands as it is.
    """
    n = Window.partitionBy(KEY, "chunk")
    sized = chunks.withColumn("n__", F.count(F.lit(1)).over(n))
    old = sized.select(KEY, (F.col("chunk") + 1).alias("chunk"), F.col("j").alias("at__"), F.col(value).alias("old__"))
    sizes = sized.select(KEY, (F.col("chunk") + 1).alias("chunk"), F.col("n__").alias("m__")).distinct()
    both = sized.join(sizes, [KEY, "chunk"], "left").withColumn("at__", F.least(consumed + F.col("j"), F.col("m__") - 1)).join(old, [KEY, "chunk", "at__"], "left")
    pending = F.col("m__") - consumed
    overlap = F.least(F.greatest(pending, F.lit(least)), F.col("n__"))
    t = F.when(overlap == 1, 0.0).otherwise(F.col("j") / F.nullif(overlap - 1, F.lit(0)))
    mixed = F.col("old__") * (1 - t) + F.col(value) * t
    plain = F.col("m__").isNull() | (pending <= 0) | (F.col("j") >= overlap)
    return both.withColumn("blended", F.when(plain, F.col(value)).otherwise(mixed)).drop("n__", "m__", "at__", "old__")


def one_change(x: np.ndarray, threshold: float = 0.5) -> np.ndarray:
    """0s and 1s with at most one change, nearest in squared error; of equal errors the first of: all 0, all 1, up, down."""
    if len(x) == 1:
        return (x > threshold).astype(float)
    n = len(x)
    up = np.arange(n)[None, :] >= np.arange(1, n)[:, None]
    patterns = np.concatenate([np.zeros((1, n)), np.ones((1, n)), up, ~up]).astype(float)
    return patterns[((patterns - x) ** 2).sum(1).argmin()]


class ActionStream:
    """Pending actions of one stream; ``put`` takes a chunk, ``pop`` gives the next action."""

    def __init__(self, queue=(), last=None, taken: int = 0):
        self.queue = [np.asarray(a, float) for a in queue]
        self.last = None if last is None else np.asarray(last, float)
        self.taken = taken

    def put(self, chunk, max_drop: int, least: int = LEAST) -> None:
        """Drop as many actions as ran since the last chunk (at most ``max_drop``), then fade from the pending ones."""
        new = [np.asarray(a, float) for a in chunk][:USED]
        drop, least = min(self.taken, max(0, int(max_drop))), max(1, int(least))
        if drop >= len(new):
            return
        new = new[drop:]
        if not self.queue and self.last is not None:
            old, self.last = [self.last] * least, None
        else:
            old = self.queue + self.queue[-1:] * max(0, least - len(self.queue))
        self.taken = 0
        if not old:
            self.queue = new
            return
        n = min(len(old), len(new))
        fade = np.linspace(1.0, 0.0, n) if n > 1 else np.ones(1)
        out = np.array([w * o + (1 - w) * a for w, o, a in zip(fade, old, new)] + new[n:])
        if out.ndim == 2 and out.shape[1] >= HANDS.stop:
            for k in range(HANDS.start, HANDS.stop):
                out[:, k] = one_change(out[:, k])
        self.queue = list(out)

    def pop(self):
        if not self.queue:
            return None
        if len(self.queue) == 1:
            self.last = self.queue[0].copy()
        self.taken += 1
        return self.queue.pop(0)


def blend_stream(events: DataFrame, max_drop: int = 8, least: int = LEAST) -> DataFrame:
    """Actions from a streaming table (stream_id, ts, seq, actions): a row with actions is a chunk, one with null is a tick.

    A tick takes the next action; with nothing pending it gives null. Rows of a micro-batch are taken in the
    order (ts, seq), chunks before ticks of the same time. State is bounded by one chunk for each stream.
    """
    out = "stream_id long, ts timestamp, seq long, action array<double>"
    state = "queue array<array<double>>, last array<double>, taken int"

    def run(key, parts: Iterator, held: GroupState):
        import pandas as pd

        queue, last, taken = held.get if held.exists else ([], None, 0)
        stream = ActionStream(queue, last, taken)
        rows = pd.concat(list(parts))
        rows["tick"] = rows["actions"].isna()
        given = []
        for ts, seq, actions, tick in rows.sort_values(["ts", "tick", "seq"])[["ts", "seq", "actions", "tick"]].itertuples(index=False):
            if tick:
                a = stream.pop()
                given.append((key[0], ts, seq, None if a is None else a.tolist()))
            else:
                stream.put([np.asarray(x, float) for x in actions], max_drop, least)
        held.update(([a.tolist() for a in stream.queue], None if stream.last is None else stream.last.tolist(), stream.taken))
        yield pd.DataFrame(given, columns=["stream_id", "ts", "seq", "action"])

    return events.groupBy("stream_id").applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def latest_values(events: DataFrame, key: str, ts: str, topic: str, value: str, topics: list[str]) -> DataFrame:
    """Sample and hold over stored events: at each event, the latest value of every topic so far."""
    w = Window.partitionBy(key).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumns({t: F.last(F.when(F.col(topic) == t, F.col(value)), True).over(w) for t in topics})


def latest_stream(events: DataFrame, topics: list[str]) -> DataFrame:
    """Sample and hold over a streaming table (stream_id, ts, seq, topic, value): a row whose topic is null is a tick, and gets the latest value of every topic.

    Rows of a micro-batch are taken in the order (ts, seq). State is one value for each topic.
    """
    out = "stream_id long, ts timestamp, seq long, " + ", ".join(f"`{t}` double" for t in topics)

    def run(key, parts: Iterator, held: GroupState):
        import pandas as pd

        last = dict(zip(topics, held.get[0] if held.exists else [None] * len(topics)))
        given = []
        for ts, seq, topic, value in pd.concat(list(parts)).sort_values(["ts", "seq"])[["ts", "seq", "topic", "value"]].itertuples(index=False):
            if topic is None or topic != topic:
                given.append((key[0], ts, seq, *last.values()))
            elif topic in last:
                last[topic] = None if value is None or value != value else float(value)
        held.update((list(last.values()),))
        yield pd.DataFrame(given, columns=["stream_id", "ts", "seq", *topics])

    return events.groupBy("stream_id").applyInPandasWithState(run, out, "latest array<double>", "append", GroupStateTimeout.NoTimeout)


def recordings(events: DataFrame) -> DataFrame:
    """Episodes from a streaming table (stream_id, ts, seq, command): ``toggle`` starts an episode and ends it, ``discard`` gives it up, null is a frame.

    A row for each frame while an episode is recorded (what: frame), one when it is saved, one when it is given up. An episode
    without frames is not saved. A discarded episode leaves its number to the next attempt. Frames are not held back, so
    state is a few numbers; ``saved`` keeps those of attempts that were saved.
    """
    out = "stream_id long, ts timestamp, seq long, episode long, attempt long, frame_index long, what string"

    def run(key, parts: Iterator, held: GroupState):
        import pandas as pd

        recording, episode, attempt, n = held.get if held.exists else (False, 0, 0, 0)
        given = []
        for ts, seq, command in pd.concat(list(parts)).sort_values(["ts", "seq"])[["ts", "seq", "command"]].itertuples(index=False):
            if command == "toggle" and not recording:
                recording, n = True, 0
            elif command in ("toggle", "discard") and recording:
                kept = command == "toggle" and n > 0
                if n:
                    given.append((key[0], ts, seq, episode, attempt, n, "saved" if kept else "discarded"))
                recording, episode, attempt = False, episode + kept, attempt + 1
            elif recording and (command is None or command != command):
                given.append((key[0], ts, seq, episode, attempt, n, "frame"))
                n += 1
        held.update((recording, episode, attempt, n))
        yield pd.DataFrame(given, columns=["stream_id", "ts", "seq", "episode", "attempt", "frame_index", "what"])

    return events.groupBy("stream_id").applyInPandasWithState(run, out, "recording boolean, episode long, attempt long, n long", "append", GroupStateTimeout.NoTimeout)


def saved(recorded: DataFrame) -> DataFrame:
    """The frames of a stored table of recordings whose attempt was saved."""
    done = recorded.where("what = 'saved'").select("stream_id", "attempt")
    return recorded.where("what = 'frame'").join(done, ["stream_id", "attempt"], "left_semi").drop("what", "attempt")


def windowed(events: DataFrame, ts: str, late: str, width: str, *aggregates) -> DataFrame:
    """Tumbling-window aggregates of a stream, which wait for rows that are late by no more than ``late``."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width)).agg(*aggregates)


def sessions(events: DataFrame, key: str, ts: str, late: str, gap: str, *aggregates) -> DataFrame:
    """Recording episodes: a key's rows with no gap longer than ``gap``."""
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap)).agg(*aggregates)


def recorder(path: str, names: list[str]):
    """For foreachBatch: each micro-batch's leaves, flattened, in a folder of its number; a batch that runs again replaces its own."""
    from strideframe.operators.transforms import flat_names, leaf

    def write(batch: DataFrame, step: int) -> None:
        leaves = [n for n in flat_names(batch.schema) if n.split("/")[0] in names]
        batch.select(*[leaf(n).alias(n) for n in leaves]).write.mode("overwrite").parquet(f"{path}/step={step}")

    return write


def serve(steps: DataFrame, max_steps: int, done: str | None = None) -> DataFrame:
    """The steps of an episode that a runtime would take: up to the first one that reports completion, or a number of steps."""
    from strideframe.operators.frames import in_order

    before = in_order().rowsBetween(Window.unboundedPreceding, -1)
    open_ = ~F.coalesce(F.max(done).over(before), F.lit(False)) if done else F.lit(True)
    return steps.withColumn("open__", open_).where(F.col("open__") & (F.col(ORDER) < max_steps)).drop("open__")
