"""Create, patch, retry and revoke commands applied to a registry.

``judge`` answers each command against one registry snapshot. ``fold`` lets the commands of one
meter see each other's effect in ``seq`` order. ``book`` is ``gas`` or ``electricity``.
"""

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from meterfold.functions.binding import bind
from meterfold.functions.text import clean
from meterfold.operators import electricity, gas
from meterfold.operators.dedup import keep_first
from meterfold.operators.merge import outer_merge, stacked_merge
from meterfold.operators.outcomes import OUTCOME_TYPE, Facts, fact_struct
from meterfold.session import ensure_checkpoint_dir, stored_once

BOOKS = {"gas": gas, "electricity": electricity}
# Short, because each step of the array fold copies the outcomes gathered so far.
CHUNK_ROWS = 256


def state_of(registry: DataFrame, book) -> DataFrame:
    """Registry as (id, state): the columns a command may change; absent columns are null."""
    columns = [
        (F.col(f.name) if f.name in registry.columns else F.lit(None)).cast(f.dataType)
        .alias(f.name)
        for f in book.STATE_TYPE if f.name != "exists"
    ]
    return registry.select(
        F.col(book.KEY).alias("id"), F.struct(F.lit(True).alias("exists"), *columns).alias("state")
    )


def _no_state(book) -> Column:
    columns = ", ".join(
        f"'{f.name}', CAST(NULL AS {f.dataType.simpleString()})"
        for f in book.STATE_TYPE if f.name != "exists")
    return F.expr(f"named_struct('exists', false, {columns})")


def addressed(commands: DataFrame, book) -> DataFrame:
    """(seq, id, op, body); a creation is addressed by the id inside its body.

    Only creations and patches have rules that read the body; the other commands travel without it.
    """
    empty = F.create_map().cast("map<string,string>")
    body = F.coalesce(F.when(F.col("op").isin("create", "patch"), F.col("body")), empty)
    target = F.when(F.col("op") == "create", clean(F.col("body")[book.KEY])).otherwise(F.col("id"))
    return commands.select("seq", target.alias("id"), "op", body.alias("body"))


def with_facts(commands: DataFrame, book, *keep: str) -> DataFrame:
    """(seq, id, f): addressed commands with their facts as one struct."""
    facts = fact_struct(book.FACT_ERRORS, book.PATCH_FIELDS, book.VALUE_COLUMNS)
    return book.add_facts(commands).select("seq", "id", *keep, facts.alias("f"))


def _verdict(f, state: Column, book) -> Column:
    bad_patch = F.when(f["op"] == "patch", book.patch_error(f, state))
    return bind(bad_patch, lambda bad: bind(
        clean(state[book.STATUS]), lambda status: book.verdict(f, state, bad, status)))


def judge(commands: DataFrame, registry: DataFrame, book, now: datetime | None = None) -> DataFrame:
    """Outcome of every command against the snapshot; with ``now`` also its next state.

    One join on the id: the registry is unique by id, so a much-addressed meter only makes the
    command side large, which adaptive execution splits. Bodies travel raw and are read after
    the join.
    """
    joined = addressed(commands, book).join(state_of(registry, book), "id", "left").withColumn(
        "state", F.coalesce("state", _no_state(book)))
    f, state = Facts(), F.col("state")
    judged = (
        book.add_facts(joined)
        .withColumn("bad_patch", F.when(F.col("op") == "patch", book.patch_error(f, state)))
        .withColumn("o", book.verdict(f, state, F.col("bad_patch")))
    )
    extra = []
    if now is not None:
        extra = [book.next_state(f, state, F.col("o"), now).alias("state")]
    return judged.select("seq", "id", "op", "o.*", *extra)


def validate_creations(commands: DataFrame, book) -> DataFrame:
    """Creation rules alone, without a registry: erreur, champ and message are null when valid."""
    rows = book.add_facts(addressed(commands, book))
    return rows.select("seq", "id", "create_error.*")


def lookup(ids: DataFrame, registry: DataFrame, book, view: DataFrame) -> DataFrame:
    """Requested ids with their view row, or the not-found outcome."""
    found = view.withColumn("_found", F.lit(True))
    joined = ids.join(found, book.KEY, "left")
    hit = F.col("_found").isNotNull()
    return joined.select(
        *[c for c in joined.columns if c != "_found"],
        F.when(hit, 200).otherwise(404).alias("http_status"),
        F.when(~hit, book.CODES["missing"]).alias("erreur"),
        F.when(~hit, book.TEXTS["missing"]).alias("message"),
    )


# --- ordered fold --------------------------------------------------------------------------

def _run(commands: Column, entry: Column, book, now: datetime) -> Column:
    """Apply an ordered array of commands to a state: struct(state, outcomes)."""

    def step(acc: Column, c: Column) -> Column:
        state, f = acc["state"], c["f"]
        return bind(_verdict(f, state, book), lambda o: F.struct(
            book.next_state(f, state, o, now).alias("state"),
            F.array_append(acc["outcomes"], F.struct(
                c["seq"].alias("seq"), f["op"].alias("op"), o.alias("o"))).alias("outcomes"),
        ))

    # An empty outcome list of the right type, whatever type ``seq`` has.
    none_yet = F.transform(F.slice(commands, 1, 0), lambda c: F.struct(
        c["seq"].alias("seq"), c["f"]["op"].alias("op"), F.lit(None).cast(OUTCOME_TYPE).alias("o")))
    start = F.struct(entry.alias("state"), none_yet.alias("outcomes"))
    return F.aggregate(commands, start, step)


def _gather(commands: DataFrame, keys: list[str]) -> DataFrame:
    """Commands of each group as one array in ``seq`` order.

    Groups are sorted by a hash first: ids share long prefixes, a hash is told apart by one comparison.
    """
    return commands.groupBy(F.xxhash64(keys[0]).alias("_hash"), *keys).agg(
        F.sort_array(F.collect_list(F.struct("seq", "f"))).alias("commands")
    ).drop("_hash")


def _entry(chunks: DataFrame, registry: DataFrame, book) -> DataFrame:
    """Add the stored state of each chunk's meter."""
    c, r = chunks.alias("c"), state_of(registry, book).alias("r")
    known = (F.col("c.place") == F.col("r.id")) & F.col("c.id").isNotNull()
    return c.join(r, known, "left").select(
        "c.*", F.coalesce("r.state", _no_state(book)).alias("state"))


def _fold_whole(commands: DataFrame, registry: DataFrame, book, now: datetime, total=None) -> DataFrame:
    """Meters whose commands fit one array: (id, outcomes, state), each array folded once.

    Raw bodies are shuffled once; facts, arrays, the state join and the fold follow in place.
    """
    local = commands.repartition("place")
    if total is not None:
        place = Window.partitionBy("place", "seq").orderBy(*total)
        local = local.withColumn("_rank", F.row_number().over(place)).where("_rank = 1 OR id IS NULL").drop("_rank")
    local = with_facts(local, book, "place")
    started = _entry(_gather(local, ["place", "id"]), registry, book)
    # Out of a generator, since a filter on plain columns would be pushed down and fold everything again.
    run = _run(F.col("commands"), F.col("state"), book, now)
    return started.select("id", F.inline_outer(F.array(run))).select("id", "outcomes", "state")


def _cut(commands: DataFrame, book, chunk_rows: int) -> DataFrame:
    """Cut long command sequences into chunks of at most ``chunk_rows`` commands, ordered by (part, block).

    A range sort on (id, seq) spreads one meter over many tasks; a chunk is a run of rows inside
    one of those tasks.
    """
    placed = (
        commands.repartitionByRange("place", "seq").sortWithinPartitions("place", "seq")
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("at", 33))
        .withColumn("block", F.floor(F.col("at").bitwiseAND((1 << 33) - 1) / chunk_rows))
        .drop("at")
    )
    cut = with_facts(placed, book, "place", "part", "block")
    return _gather(cut, ["place", "id", "part", "block"]).checkpoint()


def _exit_state(commands: Column, entry: Column, book, now: datetime) -> Column:
    """State after an ordered array of commands."""
    return F.aggregate(commands, entry, lambda state, c: bind(
        _verdict(c["f"], state, book), lambda o: book.next_state(c["f"], state, o, now)))


def _handed(rows: DataFrame, book) -> DataFrame:
    """Add to each chunk the state its predecessors leave it, ``carried``.

    Per field that is the exit value of the last earlier chunk known to write it, else the stored
    one. The last writer is sought among the chunks of the same sort task, then among the tasks
    before it, so no window holds all chunks of a meter.
    """
    fields = [f.name for f in book.STATE_TYPE]
    wrote = rows.select("*", *[
        F.when(F.col("written")[c], F.struct(F.col("exit")[c].alias("v"))).alias(f"w_{c}") for c in fields])
    before = (Window.unboundedPreceding, -1)
    near = Window.partitionBy("id", "part").orderBy("block").rowsBetween(*before)
    far = Window.partitionBy("id").orderBy("part").rowsBetween(*before)
    ends = wrote.groupBy("id", "part").agg(*[
        F.max_by(f"w_{c}", F.when(F.col(f"w_{c}").isNotNull(), F.col("block"))).alias(f"w_{c}") for c in fields])
    ends = ends.select("id", "part", *[F.last(f"w_{c}", True).over(far).alias(f"far_{c}") for c in fields])
    inside = wrote.select(*rows.columns, *[F.last(f"w_{c}", True).over(near).alias(f"near_{c}") for c in fields])
    carried = [F.coalesce(f"near_{c}", f"far_{c}", F.struct(F.col("stored")[c].alias("v")))["v"].alias(c)
               for c in fields]
    return inside.join(ends, ["id", "part"]).select(*rows.columns, F.struct(*carried).alias("carried"))


def _written(book, *known: Column) -> Column:
    """Fields a chunk is known to write: its exit differed from its entry, now or in a round before."""
    return F.struct(*[
        F.coalesce(*[F.when(k[f.name], True) for k in known],
                   ~F.col("exit")[f.name].eqNullSafe(F.col("entry")[f.name])).alias(f.name)
        for f in book.STATE_TYPE])


def _fold_cut(commands: DataFrame, registry: DataFrame, book, now: datetime, chunk_rows: int):
    """Meters with long sequences: solve all chunks at once, then repair entry states.

    Every chunk first assumes the stored state. Each round hands all chunks the state that the
    writes known so far leave them, and reruns only those whose entry changed; it ends when none
    changed. After round n the first n chunks of a meter are final, so the result is exact. An
    accepted write travels to all later chunks in one round, so further rounds are needed only
    where acceptance itself hangs on earlier chunks. The loop rewrites states, not commands or
    outcomes. Returns (id, part, block, state, outcomes).
    """
    keys = ["id", "part", "block"]
    chunks = _cut(commands, book, chunk_rows)
    run = _run(F.col("commands"), F.col("state"), book, now)
    first = _entry(chunks, registry, book).withColumn("r", run).select(
        *keys, F.col("state").alias("entry"), F.col("r.state").alias("exit"), "r.outcomes").checkpoint()
    rows = first.select(*keys, F.col("entry").alias("stored"), "entry", "exit").withColumn(
        "written", _written(book))
    commands_of = chunks.select(*keys, "commands")
    while True:
        handed = _handed(rows, book).checkpoint()
        stale = ~F.col("carried").eqNullSafe(F.col("entry"))
        if handed.where(stale).isEmpty():
            break
        rerun = handed.where(stale).join(commands_of, keys).select(
            *keys, F.struct(_exit_state(F.col("commands"), F.col("carried"), book, now).alias("x")).alias("new"))
        rows = handed.join(rerun, keys, "left").select(
            *keys, "stored", F.col("carried").alias("entry"),
            F.when(F.col("new").isNotNull(), F.col("new.x")).otherwise(F.col("exit")).alias("exit"),
            "written",
        ).withColumn("written", _written(book, F.col("written")))
    same = first.join(handed.select(*keys, F.col("entry").alias("final")), keys)
    kept = F.col("final").eqNullSafe(F.col("entry"))
    again = same.where(~kept).select(*keys, "final").join(commands_of, keys).select(
        *keys, _run(F.col("commands"), F.col("final"), book, now).alias("r"))
    return same.where(kept).select(*keys, F.col("exit").alias("state"), "outcomes").unionByName(
        again.select(*keys, "r.state", "r.outcomes")).checkpoint()


def fold(
    commands: DataFrame,
    registry: DataFrame,
    book,
    now: datetime,
    chunk_rows: int = CHUNK_ROWS,
    store: bool = False,
    total: list[Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Apply all commands of a batch in ``seq`` order per meter.

    Returns (outcomes, changes): one outcome per command, and the final state of every meter
    with at least one accepted command. ``seq`` may be of any orderable type, unique per id.
    Meters with at most ``chunk_rows`` commands fold as one array; the others, found by a count
    with map-side partial sums, are cut into chunks. ``store`` keeps the fold in files, for callers that
    use both results. With ``total`` the same ``seq`` may come more than once for an id: the first command in that
    order counts, picked where the fold has its commands anyway.
    """
    asked = addressed(commands, book)
    # Counted by hash; an id that only shares one with a busy id may be cut as well.
    asked = asked.withColumn("_hash", F.xxhash64("id"))
    long = asked.where(F.col("id").isNotNull()).groupBy("_hash").agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk_rows).select("_hash")
    # Creations without an id are refused one by one; a place of their own keeps them spread.
    asked = asked.withColumn(
        "place", F.coalesce("id", F.concat(F.lit("seq "), F.col("seq").cast("string"))))

    accepted = F.exists("outcomes", lambda x: x["o"]["http_status"].isin(200, 201))
    n_long = long.count()
    if n_long == 0:
        whole = _fold_whole(asked.drop("_hash"), registry, book, now, total)
        whole = stored_once(whole) if store else whole
        pieces, finals = whole, whole.select("id", "state", accepted.alias("accepted"))
    else:
        ensure_checkpoint_dir(commands.sparkSession)
        long = stored_once(long)
        spread = asked.withColumn("_hash", F.when(F.col("id").isNotNull(), F.col("_hash")))
        short = _fold_whole(spread.join(long, "_hash", "left_anti").drop("_hash"), registry, book, now, total)
        short = stored_once(short) if store else short
        busy = spread.join(long, "_hash", "left_semi").drop("_hash")
        busy = busy if total is None else keep_first(busy, ["id", "seq"], total)
        cut = _fold_cut(busy, registry, book, now, chunk_rows)
        last = cut.groupBy("id").agg(
            F.max_by("state", F.struct("part", "block")).alias("state"),
            F.max(accepted).alias("accepted"),
        )
        pieces = short.select("id", "outcomes").unionByName(cut.select("id", "outcomes"))
        finals = short.select("id", "state", accepted.alias("accepted")).unionByName(last)
    outcomes = pieces.select("id", F.explode("outcomes").alias("x")).select(
        "x.seq", "id", "x.op", "x.o.*")
    changes = finals.where("accepted").select(F.col("id").alias(book.KEY), "state.*").drop("exists")
    return outcomes, changes


def apply_changes(registry: DataFrame, changes: DataFrame, book, unit: list[Column] | None = None) -> DataFrame:
    """Registry after the accepted commands; columns commands never touch keep their values.

    With ``unit`` the rows are merged in the places they are written from, see ``stacked_merge``.
    """
    touched = {c: F.col("s._in") for c in changes.columns if c != book.KEY}
    if unit is not None:
        return stacked_merge(registry, changes, book.KEY, touched, unit)
    return outer_merge(registry, changes, book.KEY, touched)
