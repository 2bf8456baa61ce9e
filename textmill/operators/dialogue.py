"""Dialogue states: system turns with the state before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK_TURNS = 4096
#: Blocks whose last rows are carried together.
BLOCK_SPAN = 1 << 12
_STATE = "array<string>"


def dialogue_examples(records: DataFrame) -> DataFrame:
    """One row per system turn of nested dialogue records.

    `dialogue` is the history before the turn, `label_state` the latest user state, `prev_state` the label state of
    the system turn before, `sys_text` the turn itself. A record is one row, so its history is bounded by that row.
    """
    keys = [c for c in ("file_path", "record_no") if c in records.columns]
    turns = records.select(*keys, F.col("domains").alias("domain"), F.col("dialogue").alias("_turns"),
                           F.posexplode("dialogue").alias("turn_no", "_turn")).filter("_turn.role = 'sys'")
    history = F.slice(F.col("_turns"), F.lit(1), F.col("turn_no"))
    none = F.array().cast(_STATE)

    def latest_state(part: Column) -> Column:
        users = F.filter(part, lambda t: t["role"] == "user")
        return F.coalesce(F.get(users, F.size(users) - 1)["state"], none)

    def before_last_system_turn(part: Column) -> Column:
        places = F.filter(F.transform(part, lambda t, i: F.when(t["role"] == "sys", i)), lambda i: i.isNotNull())
        return F.slice(part, F.lit(1), F.coalesce(F.array_max(places), F.lit(0)))

    return turns.withColumn("_history", history).withColumn("_earlier", before_last_system_turn(F.col("_history"))) \
        .select(
            *keys, "turn_no", "domain",
            F.transform("_history", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
                        ).alias("dialogue"),
            latest_state(F.col("_earlier")).alias("prev_state"),
            latest_state(F.col("_history")).alias("label_state"),
            F.array().cast("array<int>").alias("slot_names"),
            F.col("_turn.text").alias("sys_text"),
        )


def carry_forward(df: DataFrame, key: str, order: str, values: dict[str, Column], totals: dict[str, Column],
                  block_rows: int = BLOCK_TURNS, block: Column | None = None) -> DataFrame:
    """Add running columns over the rows *before* each row of its key.

    `values`: last non-null value so far; `totals`: sum so far. A key may hold any number of rows: they are handled
    in blocks of `block_rows` order values, or those that `block` numbers in order, each a group of its own. The last row of a block is
    carried along the next `BLOCK_SPAN` blocks, and the last of these along the key, so the rows that one task orders are few.
    `(key, order)` must be unique and `order` a non-negative integer.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / F.lit(block_rows)) if block is None else block)
    zero = F.lit(0).cast("long")
    group = Window.partitionBy(key, "_block").orderBy(order)
    before = group.rowsBetween(Window.unboundedPreceding, -1)
    staged = blocked.withColumns({f"_v_{n}": c for n, c in values.items()} | {f"_t_{n}": c for n, c in totals.items()})
    inside = staged.withColumns(
        {f"_i_{n}": F.last(f"_v_{n}", ignorenulls=True).over(before) for n in values}
        | {f"_s_{n}": F.coalesce(F.sum(f"_t_{n}").over(before), zero) for n in totals}
        | {"_ends": F.lead(order).over(group).isNull()})
    ends = inside.filter("_ends").select(
        key, "_block", F.floor(F.col("_block") / BLOCK_SPAN).alias("_span"),
        *[F.coalesce(f"_v_{n}", f"_i_{n}").alias(f"_b_{n}") for n in values],
        *[(F.coalesce(f"_t_{n}", zero) + F.col(f"_s_{n}")).alias(f"_c_{n}") for n in totals])
    near = Window.partitionBy(key, "_span").orderBy("_block")
    earlier = near.rowsBetween(Window.unboundedPreceding, -1)
    steps = ends.select(
        key, "_block", "_span", F.lead("_block").over(near).isNull().alias("_last"), *[f"_b_{n}" for n in values], *[f"_c_{n}" for n in totals],
        *[F.last(f"_b_{n}", ignorenulls=True).over(earlier).alias(f"_n_{n}") for n in values],
        *[F.coalesce(F.sum(f"_c_{n}").over(earlier), zero).alias(f"_m_{n}") for n in totals])
    far = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = steps.filter("_last").select(
        key, "_span",
        *[F.last(F.coalesce(f"_b_{n}", f"_n_{n}"), ignorenulls=True).over(far).alias(f"_f_{n}") for n in values],
        *[F.coalesce(F.sum(F.col(f"_c_{n}") + F.col(f"_m_{n}")).over(far), zero).alias(f"_g_{n}") for n in totals])
    carried = steps.join(spans, [key, "_span"]).select(
        key, "_block",
        *[F.coalesce(f"_n_{n}", f"_f_{n}").alias(f"_b_{n}") for n in values],
        *[(F.col(f"_m_{n}") + F.col(f"_g_{n}")).alias(f"_c_{n}") for n in totals])
    return inside.join(carried, [key, "_block"]).select(
        *df.columns,
        *[F.coalesce(f"_i_{n}", f"_b_{n}").alias(n) for n in values],
        *[(F.col(f"_s_{n}") + F.coalesce(f"_c_{n}", zero)).alias(n) for n in totals])


def dialogue_states(turns: DataFrame, system_role: str = "sys", user_role: str = "user", key: str = "conv_id",
                    order: str = "turn", state: str = "text", block_rows: int = BLOCK_TURNS) -> DataFrame:
    """System turns of a turn table `(key, order, role, text)` with label state, previous state and history extent.

    The history of a turn is the prefix of its conversation, given as `history_turns` and `history_chars`; the turn
    table itself holds the text once, however long a conversation grows. Conversations are handled in blocks of
    `block_rows` order values, as in `carry_forward`.
    """
    is_system = F.col("role") == system_role
    staged = turns.select(
        key, order, F.col("text").alias("_text"), is_system.alias("_system"),
        F.when(F.col("role") == user_role, F.col(state)).alias("_said"),
        F.floor(F.col(order) / F.lit(block_rows)).alias("_block"))
    block = Window.partitionBy(key, "_block").orderBy(order)
    before = block.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    # The state within the block, then the state that the last system turn of the block saw.
    inside = staged.withColumns({
        "_user": F.last("_said", ignorenulls=True).over(before),
        "_turns": F.count("*").over(before),
        "_chars": F.coalesce(F.sum(F.length("_text")).over(before), zero),
        "_ends": F.lead(order).over(block).isNull(),
    }).withColumn("_saw", F.when(F.col("_system"), F.struct(F.col("_user").alias("state")))
                  ).withColumn("_seen", F.last("_saw", ignorenulls=True).over(before))
    # One row per block; a block without an own user turn has seen the state carried into it.
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = inside.filter("_ends").select(
        key, "_block", F.coalesce("_said", "_user").alias("_last"), F.coalesce("_saw", "_seen").alias("_last_seen"),
        (F.col("_turns") + 1).alias("_n"), (F.col("_chars") + F.length("_text")).alias("_c"))
    carried = ends.withColumns({
        "_user_in": F.last("_last", ignorenulls=True).over(earlier),
        "_turns_in": F.coalesce(F.sum("_n").over(earlier), zero),
        "_chars_in": F.coalesce(F.sum("_c").over(earlier), zero),
    }).withColumn("_resolved", F.when(F.col("_last_seen").isNotNull(), F.struct(
        F.coalesce(F.col("_last_seen.state"), F.col("_user_in")).alias("state")))
    ).withColumn("_seen_in", F.last("_resolved", ignorenulls=True).over(earlier))
    system = inside.filter("_system").join(
        carried.select(key, "_block", "_user_in", "_turns_in", "_chars_in", "_seen_in"), [key, "_block"])
    previous = F.when(F.col("_seen").isNotNull(), F.coalesce(F.col("_seen.state"), F.col("_user_in"))).otherwise(
        F.col("_seen_in.state"))
    return system.select(
        key, order, F.col("_text").alias("sys_text"), F.coalesce("_user", "_user_in").alias("label_state"),
        previous.alias("prev_state"), (F.col("_turns") + F.col("_turns_in")).alias("history_turns"),
        (F.col("_chars") + F.col("_chars_in")).alias("history_chars"))
