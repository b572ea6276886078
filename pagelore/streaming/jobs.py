"""Jobs, queues and retention: as folds over an ordered log, and the same as stateful streams.

A queue of a service is served by one scheduler, in order; that part is serial by nature and is done by key of the
queue's owner. Everything else is windows and aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("succeeded", "failed", "cancelled")
#: Which event takes a job from which states to which.
TRANSITIONS = {"start": (("queued",), "running"), "succeed": (("running",), "succeeded"), "fail": (("running",), "failed"), "cancel": (("queued",), "cancelled")}


def next_state(state: Column, event: Column) -> Column:
    """The state after an event; an event that isn't allowed changes nothing."""
    out = state
    for name, (allowed, target) in TRANSITIONS.items():
        out = F.when((event == name) & state.isin(*allowed), target).otherwise(out)
    return out


def job_states(log: DataFrame, *, job: str, at: list[str], event: str) -> DataFrame:
    """job, state, steps, rejected: each job's log in order, from queued.

    No state is entered twice, so a job leaves a state by the first event after its entry that the state allows. Each step is
    a partial aggregate over the log: nobody's events are gathered.
    """
    rows = log.select(F.col(job).alias("job"), F.struct(*at).alias("at"), F.col(event).alias("event"))
    moves = lambda state: F.coalesce(*[F.when((F.col("event") == name) & state.isin(*allowed), target) for name, (allowed, target) in TRANSITIONS.items()])
    first = moves(F.lit("queued"))
    one = rows.groupBy("job").agg(F.min(F.when(first.isNotNull(), F.struct("at", first.alias("state")))).alias("one"), F.count(F.lit(1)).alias("n"))
    later = rows.join(one.select("job", "one.at", "one.state").withColumnsRenamed({"job": "its job", "at": "since"}), F.col("job") == F.col("its job")).where(F.col("at") > F.col("since"))
    second = moves(F.col("state"))
    two = later.where(second.isNotNull()).groupBy("job").agg(F.min(F.struct("at", second.alias("state"))).alias("two"))
    out = one.join(two, "job", "left")
    steps = (F.col("one").isNotNull().cast("int") + F.col("two").isNotNull().cast("int")).cast("int")
    return out.select(F.col("job").alias(job), F.coalesce("two.state", "one.state", F.lit("queued")).alias("state"), steps.alias("steps"), (F.col("n") - steps).cast("int").alias("rejected"))


def elapsed(finished: Column, started: Column, queued: Column, now: Column) -> Column:
    return F.greatest(F.coalesce(finished, now) - F.coalesce(started, queued), F.lit(0))


def expired(finished: Column, ttl: int, now: Column) -> Column:
    """A finished job goes when its time is up, at the very end of it too."""
    return F.coalesce(finished + ttl <= now, F.lit(False))


def retention(jobs: DataFrame, *, owner: str, max_jobs: int, max_bytes: int) -> DataFrame:
    """jobs (id, state, finished, queued, seq, original_bytes, result_bytes) with action: keep, evict_count, release or evict_bytes.

    First the oldest finished jobs over the number go. Then, while the bytes are over theirs, originals are released from the
    oldest on, and when none is left whole jobs go. Jobs under way stay, but their bytes count.
    """
    done = F.col("state").isin(*TERMINAL)
    age = [F.coalesce("finished", "queued"), F.col("seq")]
    newest = Window.partitionBy(owner, "done").orderBy(*[c.desc() for c in age])
    rows = jobs.withColumn("done", done).withColumn("nth_new", F.row_number().over(newest))
    rows = rows.withColumn("over_count", F.col("done") & (F.col("nth_new") > max_jobs))
    left = ~F.col("over_count")
    every = Window.partitionBy(owner)
    size = F.col("original_bytes") + F.col("result_bytes")
    rows = rows.withColumn("excess", F.coalesce(F.sum(F.when(left, size)).over(every), F.lit(0)) - max_bytes)
    oldest = Window.partitionBy(owner).orderBy(*age).rowsBetween(Window.unboundedPreceding, -1)
    can = F.col("done") & left
    rows = rows.withColumn("freed_before", F.coalesce(F.sum(F.when(can, F.col("original_bytes"))).over(oldest), F.lit(0)))
    rows = rows.withColumn("all_originals", F.coalesce(F.sum(F.when(can, F.col("original_bytes"))).over(every), F.lit(0)))
    rows = rows.withColumn("results_before", F.coalesce(F.sum(F.when(can, F.col("result_bytes"))).over(oldest), F.lit(0)))
    release = can & (F.col("original_bytes") > 0) & (F.col("excess") > F.col("freed_before"))
    evict = can & (F.col("excess") - F.col("all_originals") > F.col("results_before"))
    action = F.when(F.col("over_count"), "evict_count").when(evict, "evict_bytes").when(release, "release").otherwise("keep")
    return rows.select(*jobs.columns, action.alias("action"))


def queue_positions(jobs: DataFrame, *, queue: list[str], at: list[str]) -> DataFrame:
    """The queued jobs with their place in line, from 0."""
    return jobs.where(F.col("state") == "queued").withColumn("position", (F.row_number().over(Window.partitionBy(*queue).orderBy(*at)) - 1).cast("int"))


def replay(arrivals: DataFrame, *, owner: str, at: list[str], job: str, kind: str, text_quota: int, formula_quota: int) -> DataFrame:
    """owner, job, served: the order in which one scheduler serves a backlog of two queues.

    Text first up to its quota, then formula; a queue that is empty yields; both counts begin anew only when both quotas are
    met. So rounds are alike until a queue is empty, and a job's place is its number in its queue and what the other
    queue has been given before its round.
    """
    line = Window.partitionBy(owner, kind).orderBy(*at)
    rows = arrivals.select(owner, job, kind, (F.row_number().over(line) - 1).alias("nth"))
    text = F.col(kind) == "text"
    sizes = arrivals.groupBy(owner).agg(F.count_if(text).alias("texts"), F.count_if(F.col(kind) == "formula").alias("formulas"))
    before_text = F.least("formulas", F.floor(F.col("nth") / text_quota) * formula_quota)
    before_formula = F.least("texts", (F.floor(F.col("nth") / formula_quota) + 1) * text_quota)
    out = rows.join(sizes, owner)
    return out.select(owner, job, (F.col("nth") + F.when(text, before_text).otherwise(before_formula)).cast("int").alias("served"))


def queue_replay(log: DataFrame, *, owner: str, at: list[str], text_quota: int, formula_quota: int, capacity: int) -> DataFrame:
    """owner, at, outcome: a log of enqueue, take and remove (op, kind, id), interleaved, as one scheduler answers it.

    enqueue says the place in line or busy, take the id or nothing, remove whether the id waited. Arrivals don't begin the
    counts anew. A scheduler answers one call after the other, so an owner's log is walked in order; what is held is
    the two queues, which `capacity` bounds.
    """
    shape = ", ".join([log.select(owner, *at).schema.simpleString()[len("struct<") : -1].replace(":", " ").replace(",", ", "), "outcome string"])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        lines: dict[str, dict[str, None]] = {"text": {}, "formula": {}}
        served, said = {"text": 0, "formula": 0}, []
        pdf = pdf.sort_values(at)
        for op, kind, one in zip(pdf["op"], pdf["kind"], pdf["id"].astype(str), strict=True):
            if op == "enqueue":
                if len(lines[kind]) >= capacity:
                    said.append("busy")
                else:
                    lines[kind][one] = None
                    said.append(str(len(lines[kind]) - 1))
            elif op == "remove":
                said.append("removed" if one in lines[kind] else "absent")
                lines[kind].pop(one, None)
            else:
                now = "text" if lines["text"] and (not lines["formula"] or served["text"] < text_quota) else "formula"
                if not lines[now]:
                    said.append("nothing")
                    continue
                first = next(iter(lines[now]))
                del lines[now][first]
                said.append(first)
                served[now] += 1
                if served["text"] >= text_quota and served["formula"] >= formula_quota:
                    served = {"text": 0, "formula": 0}
        return pdf[[owner, *at]].assign(outcome=said)

    return log.select(owner, *at, "op", "kind", "id").groupBy(owner).applyInPandas(walk, shape)


def insert_jobs(arrivals: DataFrame, *, owner: str, at: list[str], job: str, size: str) -> DataFrame:
    """arrivals with accepted (an id that is held already is refused), seq (from 0, of those accepted) and retained (their bytes so far)."""
    line = Window.partitionBy(owner).orderBy(*at).rowsBetween(Window.unboundedPreceding, 0)
    again = F.row_number().over(Window.partitionBy(owner, job).orderBy(*at)) > 1
    rows = arrivals.withColumn("accepted", ~again)
    counted = F.sum(F.col("accepted").cast("long")).over(line)
    return rows.withColumns({"seq": F.when(F.col("accepted"), counted - 1), "retained": F.sum(F.when(F.col("accepted"), F.col(size)).otherwise(0)).over(line)})


def look_up_jobs(asked: DataFrame, live: DataFrame, evicted: DataFrame, *, job: str) -> DataFrame:
    """asked with found: live, evicted or not_found."""
    known = live.select(F.col(job), F.lit(1).alias("rank")).unionByName(evicted.select(F.col(job), F.lit(2).alias("rank"))).groupBy(job).agg(F.min("rank").alias("rank"))
    return asked.join(known, job, "left").withColumn("found", F.when(F.col("rank") == 1, "live").when(F.col("rank") == 2, "evicted").otherwise("not_found")).drop("rank")


def remove_queued(queue: DataFrame, cancelled: DataFrame, *, by: list[str], at: list[str], job: str) -> DataFrame:
    """What is left of queues once the cancelled (by, job) are taken out, with the new places in line."""
    left = queue.join(cancelled.select(*by, job).distinct(), [*by, job], "left_anti")
    return left.withColumn("position", (F.row_number().over(Window.partitionBy(*by).orderBy(*at)) - 1).cast("int"))


def retain_only(results: DataFrame, live: DataFrame, *, owner: str, job: str, size: str) -> tuple[DataFrame, DataFrame]:
    """(the results of live jobs, and by owner how many went and what is left of the bytes)."""
    ids = live.select(owner, job).distinct().withColumn("is live", F.lit(True))
    marked = results.join(ids, [owner, job], "left").withColumn("is live", F.coalesce("is live", F.lit(False)))
    summary = marked.groupBy(owner).agg(F.count_if(~F.col("is live")).alias("removed"), F.coalesce(F.sum(F.when(F.col("is live"), F.col(size))), F.lit(0)).alias("bytes"))
    return marked.where("`is live`").drop("is live"), summary


#: Which states an engine may enter another from.
ENGINE = {
    "loading": ("blocked", "ready", "failed"), "ready": ("loading", "rebuilding"), "failed": ("loading", "rebuilding"),
    "blocked": ("blocked",), "rebuilding": ("ready",),
}


def engine_step(state: Column, target: Column) -> Column:
    """struct<legal,allowed>: may an engine in `state` enter `target`, and from which states may it be entered?"""
    allowed = F.try_element_at(F.create_map(*[x for k, v in ENGINE.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), target)
    return F.struct(F.coalesce(F.array_contains(allowed, state), F.lit(False)).alias("legal"), F.array_join(allowed, ", ").alias("allowed"))


def wait_bound(capacity: Column, other_quota: int) -> Column:
    return capacity * other_quota


def within_budget(df: DataFrame, *, owner: str, at: list[str], size: str, total: int) -> DataFrame:
    """df with used (bytes up to here) and accepted: the running sum stays within the total."""
    w = Window.partitionBy(owner).orderBy(*at).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(size).over(w)).withColumn("accepted", F.col("used") <= total)


def admission(route: Column, token: Column, host: Column, origin: Column, slot: Column, length: Column, so_far: Column, most: int) -> Column:
    """The first gate that stops a request, else admitted."""
    return (
        F.when(~route, "route").when(~token, "unauthorized").when(~host, "host").when(~origin, "origin").when(~slot, "busy")
        .when(so_far > most, "too_large").when(length > most, "too_large").when(length < so_far, "bad_request").otherwise("admitted")
    )


def engine_admission(state: Column) -> Column:
    return F.when(state == "ready", "run").when(state == "blocked", "models_missing").when(state.isin("loading", "rebuilding"), "queue").otherwise("unavailable")


def digest_causes(seen: DataFrame, *, path: str, at: list[str], size: str, partial: str) -> DataFrame:
    """The observations of files with cause: first_sight, stat_changed (size), content_changed (first and last bytes) or hit. The time of change says nothing."""
    w = Window.partitionBy(path).orderBy(*at)
    last = F.lag(size).over(w)
    cause = F.when(F.row_number().over(w) == 1, "first_sight").when(last != F.col(size), "stat_changed").when(F.lag(partial).over(w) != F.col(partial), "content_changed").otherwise("hit")
    return seen.withColumn("cause", cause)


# --- streams


def job_states_stream(log: DataFrame, *, job: str, event: str) -> DataFrame:
    """The stream's twin of job_states: each batch gives the new state of the jobs it touched. Events of a batch are taken in order of `seq`."""
    shape, held = "job string, state string, steps int, rejected int", "state string, steps int, rejected int"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, steps, rejected = state.get if state.exists else ("queued", 0, 0)
        for name in pd.concat(list(batches)).sort_values("seq")["event"]:
            allowed, target = TRANSITIONS.get(name, ((), now))
            moved = now in allowed
            now, steps, rejected = (target if moved else now), steps + moved, rejected + (not moved)
        state.update((now, steps, rejected))
        yield pd.DataFrame({"job": [str(key[0])], "state": [now], "steps": [steps], "rejected": [rejected]})

    rows = log.select(F.col(job).cast("string").alias("job"), F.col(event).alias("event"), F.col("seq").cast("long").alias("seq"))
    return rows.groupBy("job").applyInPandasWithState(step, shape, held, "update", "NoTimeout")


def result_cache_stream(log: DataFrame, *, owner: str, most: int, max_bytes: int) -> DataFrame:
    """owner, id, accepted of a stream (owner, id, bytes, seq): an id that is held, an entry over the number or the bytes is refused."""
    shape, held = "owner string, id string, accepted boolean", "ids array<string>, bytes long"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ids, used = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        said = []
        for one, size in zip(rows["id"], rows["bytes"], strict=True):
            good = one not in ids and len(ids) < most and used + size <= max_bytes
            if good:
                ids.append(one)
                used += int(size)
            said.append(good)
        state.update((ids, used))
        yield pd.DataFrame({"owner": str(key[0]), "id": rows["id"].astype(str), "accepted": said})

    rows = log.select(F.col(owner).cast("string").alias("owner"), F.col("id").cast("string").alias("id"), F.col("bytes").cast("long").alias("bytes"), F.col("seq").cast("long").alias("seq"))
    return rows.groupBy("owner").applyInPandasWithState(step, shape, held, "update", "NoTimeout")
