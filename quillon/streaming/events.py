"""Event streams: watermarked windows, and the fold of a request's events into one row, on a batch or a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS_THAT_END = ("done", "rejected", "error")


def windowed(events: DataFrame, width: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """window_start, event_type, n, total; on a stream the watermark closes windows, on a batch it is idle."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    return kept.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """user_id, session_start, n: a gap longer than `gap` begins a session."""
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    return kept.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


def request_rows(events: DataFrame) -> DataFrame:
    """request_id, status, answer, refused from (request_id, seq, event, data): tokens joined in order unless the
    final event has an answer; without a final event the status is aborted and the answer null."""
    end = F.col("event").isin(*KINDS_THAT_END)
    tokens = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("event") == "token", F.struct("seq", "data")))), lambda x: x["data"]), "")
    g = events.groupBy("request_id").agg(F.max_by(F.when(end, F.col("event")), F.when(end, F.col("seq"))).alias("final"), F.max_by(F.when(end, F.col("data")), F.when(end, F.col("seq"))).alias("data"), tokens.alias("tokens"))
    answer = F.get_json_object("data", "$.answer")
    return g.select("request_id", F.coalesce("final", F.lit("aborted")).alias("status"), F.when(F.col("final") == "done", F.coalesce(answer, F.col("tokens"))).alias("answer"))


def round_answers(events: DataFrame) -> DataFrame:
    """request_id, answer from (request_id, seq, round, event, data): the tokens of the last round that isn't a thought.

    A round with a `thought` event is one. The answer of the `done` event goes before the tokens. Requests
    without tokens or a done event have a null answer.
    """
    token = F.when(F.col("event") == "token", F.struct("seq", "data"))
    rounds = events.groupBy("request_id", "round").agg(
        F.max(F.col("event") == "thought").alias("thought"),
        F.array_join(F.transform(F.array_sort(F.collect_list(token)), lambda x: x["data"]), "").alias("tokens"),
        F.count(token).alias("n"),
        F.max(F.when(F.col("event") == "done", F.struct("seq", "data"))).alias("done"),
    )
    spoken = ~F.col("thought") & (F.col("n") > 0)
    g = rounds.groupBy("request_id").agg(F.max_by(F.when(spoken, F.col("tokens")), F.when(spoken, F.col("round"))).alias("tokens"), F.max("done").alias("done"))
    return g.select("request_id", F.coalesce(F.get_json_object("done.data", "$.answer"), F.col("tokens")).alias("answer"))


FOLDED = "request_id string, status string, answer string, elapsed_ms double"
_STATE = "tokens string, first double, last double"


def once_each(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events without those that are sent again, by request and place; on a stream within the watermark."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["request_id", "seq"])
    return events.dropDuplicates(["request_id", "seq"])


def folded_stream(events: DataFrame, late: str = "1 minute", patience_ms: int = 60_000) -> DataFrame:
    """A row for each request of a stream (request_id, seq, event, data, ts), as soon as its last event comes.

    Tokens are joined; an answer in the `done` event goes before them. A request that hears nothing for
    patience_ms of event time after its last event is `aborted`, without an answer, but with the time it lasted.
    Only the tokens so far and two times are kept for each open request.
    """
    import json

    ends = KINDS_THAT_END

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tokens, first, last = state.get if state.exists else ("", float("inf"), float("-inf"))
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], "aborted", None, (last - first) * 1000)], columns=["request_id", "status", "answer", "elapsed_ms"])
            return
        rows = pd.concat(list(batches)).sort_values("seq")
        times = rows["ts"].astype("int64") / 10 ** {"ns": 9, "us": 6, "ms": 3, "s": 0}[rows["ts"].dt.unit]
        first, last = min(first, float(times.min())), max(last, float(times.max()))
        tokens += "".join(rows.loc[rows["event"] == "token", "data"])
        final = rows[rows["event"].isin(ends)]
        if len(final):
            end = final.iloc[-1]
            told = json.loads(end["data"] or "{}") if end["event"] == "done" else {}
            answer = (told.get("answer") if isinstance(told.get("answer"), str) else tokens) if end["event"] == "done" else None
            state.remove()
            yield pd.DataFrame([(key[0], end["event"], answer, (last - first) * 1000)], columns=["request_id", "status", "answer", "elapsed_ms"])
        else:
            state.update((tokens, first, last))
            state.setTimeoutTimestamp(max(int(last * 1000), state.getCurrentWatermarkMs()) + patience_ms)

    seen = events.withWatermark("ts", late) if not events.isStreaming else once_each(events, late)
    return seen.groupBy("request_id").applyInPandasWithState(fold, FOLDED, _STATE, "append", "EventTimeTimeout")


ROUNDS = "request_id string, status string, answer string, first_token_ms double, total_ms double, sources array<string>, steps long, open boolean"
STATUS = {"rejected": "rejected_gate", "error": "error"}


def round_rows(events: DataFrame) -> DataFrame:
    """A row for each request of (request_id, seq, round, event, data, ts): status, answer, first_token_ms, total_ms, sources, steps.

    Tokens of a round with a `thought` event are no answer; the last other round with tokens is, unless the `done` event brings one. Its
    first token gives first_token_ms, from the request's first event on; both ends are stripped of white space. A `rejected` or
    `error` event gives the status, the last of them. `retrieval` events bring lists of chunks (JSON), of which sources has all, in the order in which they
    came first; `step` events are counted. Events sent again, of one request and seq, are one; the first of `ts` counts. Null data is empty.
    """
    e = events.groupBy("request_id", "seq").agg(*[F.min_by(F.struct("round", "event", F.coalesce("data", F.lit("")).alias("data")), "ts").alias("x"), F.min("ts").alias("ts")]).select("request_id", "seq", "x.*", "ts")
    token = F.when(F.col("event") == "token", F.struct("seq", "data"))
    rounds = e.groupBy("request_id", "round").agg(
        F.max(F.col("event") == "thought").alias("thought"), F.array_join(F.transform(F.array_sort(F.collect_list(token)), lambda x: x["data"]), "").alias("told"),
        F.min(F.when(F.col("event") == "token", F.col("ts"))).alias("spoke"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.count_if(F.col("event") == "step").alias("steps"),
        F.max(F.when(F.col("event") == "done", F.struct("seq", "data"))).alias("done"), F.max(F.when(F.col("event").isin(*STATUS), F.struct("seq", "event"))).alias("end"),
    )
    spoken = F.when(~F.col("thought") & F.col("spoke").isNotNull(), F.col("round"))
    g = rounds.groupBy("request_id").agg(
        F.max_by(F.struct("told", "spoke"), spoken).alias("said"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("steps").alias("steps"), F.max("done").alias("done"), F.max("end").alias("end"),
    )
    found = e.where("event = 'retrieval'").select("request_id", "seq", F.posexplode(F.from_json("data", "array<string>")).alias("at", "chunk"))
    found = found.groupBy("request_id", "chunk").agg(F.min(F.struct("seq", "at")).alias("at"))
    sources = found.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "chunk"))), lambda x: x["chunk"]).alias("sources"))
    seconds = lambda t: t.cast("timestamp").cast("double")
    ms = lambda later: F.round((seconds(later) - seconds(F.col("first"))) * 1000, 3)
    status = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), F.col("end.event")), F.lit("answered"))
    answer = F.regexp_replace(F.coalesce(F.get_json_object("done.data", "$.answer"), F.col("said.told"), F.lit("")), r"(?U)^\s+|\s+$", "")
    out = g.join(sources, "request_id", "left")
    none = F.array().cast("array<string>")
    return out.select("request_id", status.alias("status"), answer.alias("answer"), ms(F.col("said.spoke")).alias("first_token_ms"), ms(F.col("last")).alias("total_ms"), F.coalesce("sources", none).alias("sources"), "steps")


def round_stream(events: DataFrame, late: str = "10 minutes", patience_ms: int = 600_000) -> DataFrame:
    """round_rows on a stream, in update mode: each request's row anew whenever events of it come, with its sources whole, so that the last row of a request replaces all before it.

    `open` is false in the row that comes when nothing was heard of a request for patience_ms of event time: its state is gone then.
    Until that, events that come late or again find their place by seq. The state of an open request is its own events, without those of one seq that came again.
    """
    import json

    columns = [c.split()[0] for c in ROUNDS.split(", ")]

    def row(request: str, held: dict[int, list], open_: bool) -> pd.DataFrame:
        e = sorted(held.items())
        thoughts = {x[0] for _, x in e if x[1] == "thought"}
        rounds = {x[0] for _, x in e if x[1] == "token"} - thoughts
        said = [x for _, x in e if x[1] == "token" and rounds and x[0] == max(rounds)]
        first, last = min(x[3] for _, x in e), max(x[3] for _, x in e)
        ends = [x[1] for _, x in e if x[1] in STATUS]
        done = [x[2] for _, x in e if x[1] == "done"]
        told = (json.loads(done[-1] or "{}") if done else {}).get("answer")
        answer = (told if isinstance(told, str) else "".join(x[2] for x in said)).strip()
        sources = list(dict.fromkeys(c for _, x in e if x[1] == "retrieval" for c in json.loads(x[2] or "[]")))
        spoke = round((min(x[3] for x in said) - first) * 1000, 3) if said else None
        values = (request, STATUS.get(ends[-1], "answered") if ends else "answered", answer, spoke, round((last - first) * 1000, 3), sources, sum(x[1] == "step" for _, x in e), open_)
        return pd.DataFrame([values], columns=columns)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = {int(k): v for k, v in json.loads(state.get[0]).items()} if state.exists else {}
        if state.hasTimedOut:
            state.remove()
            yield row(key[0], held, False)
            return
        for b in batches:
            seconds = b["ts"].astype("int64") / 10 ** {"ns": 9, "us": 6, "ms": 3, "s": 0}[b["ts"].dt.unit]
            for seq, rnd, event, data, ts in zip(b["seq"], b["round"], b["event"], b["data"], seconds, strict=True):
                if int(seq) not in held or ts < held[int(seq)][3]:
                    held[int(seq)] = [int(rnd), event, data or "", float(ts)]
        state.update((json.dumps(held),))
        state.setTimeoutTimestamp(max(int(max(x[3] for x in held.values()) * 1000), state.getCurrentWatermarkMs()) + patience_ms)
        yield row(key[0], held, True)

    return events.withWatermark("ts", late).groupBy("request_id").applyInPandasWithState(fold, ROUNDS, "held string", "update", "EventTimeTimeout")
