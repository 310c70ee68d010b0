"""What was said last: as-of lookups in conversations, and entities by how recent and frequent they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import table
from .ordering import placed, running

#: How recency fades by turn, and how it weighs against frequency.
FADES, RECENT, FREQUENT = 0.15, 0.6, 0.4
MENTION = "[A-Z][a-z]{6,}"


def as_of(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], inclusive: bool = False) -> DataFrame:
    """``left`` with ``values`` of the last row of ``right`` before each (or also at it): ``asof_<on>`` and ``asof_<value>``.

    Both sides become one ordered table, in which each row looks back for the last row of the right side; groups of any
    size spread over ranges.  Of right rows at one place the one with the largest values stands.

    Defined results: without an earlier row, and where ``on`` is null, the looked-up columns are null; null groups match
    one another; every left row comes back once.
    """
    own = [c for c in left.columns if c not in (*by, on)]
    found = F.struct(F.col(on).alias("_at"), *(F.col(v).alias(f"_{k}") for k, v in enumerate(values)))
    kinds = left.select(F.struct(*own).alias("_row") if own else F.struct(F.lit(1).alias("_")).alias("_row")).schema["_row"].dataType
    rights = right.where(F.col(on).isNotNull()).groupBy(*by, on).agg(F.max(found).alias("_found"))
    a = left.select(*by, on, F.lit(1 if inclusive else 0).alias("_side"), F.struct(*own).alias("_row") if own else F.struct(F.lit(1).alias("_")).alias("_row"), F.lit(None).cast(rights.schema["_found"].dataType).alias("_found"), F.lit(True).alias("_left"))
    b = rights.select(*by, on, F.lit(0 if inclusive else 1).alias("_side"), F.lit(None).cast(kinds).alias("_row"), "_found", F.lit(False).alias("_left"))
    rows = running(a.unionByName(b), by, [on, "_side"], {"_last": ("last", "_found")}).where("_left")
    made = [F.when(F.col(on).isNotNull(), F.col("_last._at")).alias(f"asof_{on}"), *(F.when(F.col(on).isNotNull(), F.col(f"_last._{k}")).alias(f"asof_{v}") for k, v in enumerate(values))]
    picked = [F.col(c) if c in (*by, on) else F.col(f"_row.{c}").alias(c) for c in left.columns]
    return rows.select(*picked, *made)


def mentions_by_turn(turns: DataFrame, pattern: str = MENTION) -> DataFrame:
    """conv_id, turn, entity (lowered), n."""
    each = turns.select("conv_id", "turn", F.explode(F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.lower)).alias("entity"))
    return each.groupBy("conv_id", "turn", "entity").agg(F.count("*").alias("n"))


def last_mentions(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, asof_turn, asof_entity, recency of each turn: the entity last named before it (of one turn the
    last in order of letters), and how fresh that is: 1, less 0.15 for each turn gone by, at least 0."""
    named = mentions_by_turn(turns).groupBy("conv_id", "turn").agg(F.max("entity").alias("entity"))
    found = as_of(turns.select("conv_id", "turn", "role"), named, ["conv_id"], "turn", ["entity"])
    return found.withColumn("recency", F.round(F.greatest(F.lit(0.0), 1 - FADES * (F.col("turn") - F.col("asof_turn") - 1)), 6))


def context_entities(turns: DataFrame, most: int = 5) -> DataFrame:
    """conv_id, rank, entity, frequency, recency, salience: each conversation's ``most`` salient entities.

    Frequency counts the turns that name the entity, as a share of the most frequent one's; recency fades from the
    conversation's last turn.  Ties go to the smaller entity.
    """
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("end"))
    each = mentions_by_turn(turns).groupBy("conv_id", "entity").agg(F.count("*").alias("frequency"), F.max("turn").alias("seen"))
    top = each.groupBy("conv_id").agg(F.max("frequency").alias("top"))
    rows = each.join(last, "conv_id").join(top, "conv_id")
    recency = F.greatest(F.lit(0.0), 1 - FADES * (F.col("end") - F.col("seen")))
    salience = F.round(RECENT * recency + FREQUENT * F.col("frequency") / F.col("top"), 4)
    scored = rows.select("conv_id", "entity", "frequency", F.round(recency, 4).alias("recency"), salience.alias("salience"), (-salience).alias("_less"))
    ranked = placed(scored, ["conv_id"], ["_less", "entity"]).where(F.col("place") <= most)
    return ranked.select("conv_id", F.col("place").cast("int").alias("rank"), "entity", "frequency", "recency", "salience")


_MENTIONS = rf"""e AS (SELECT conv_id, turn, unnest(list_transform(regexp_extract_all(text, '{MENTION}'), lambda x: lower(x))) AS entity FROM conversations),
m AS (SELECT conv_id, turn, entity, count(*) AS n FROM e GROUP BY ALL)"""


def queries() -> dict[str, tuple]:
    turns = lambda f: lambda spark, d: f(table(spark, d, "conversations"))
    return {
        "last_mentions": (
            turns(last_mentions),
            f"""WITH {_MENTIONS}, named AS (SELECT conv_id, turn, max(entity) AS entity FROM m GROUP BY ALL)
            SELECT c.conv_id, c.turn, c.role, n.turn AS asof_turn, n.entity AS asof_entity, round(CASE WHEN n.turn IS NOT NULL THEN greatest(0.0, 1 - 0.15 * (c.turn - n.turn - 1)) ELSE 0.0 END, 6)::DOUBLE AS recency
            FROM conversations c ASOF LEFT JOIN named n ON c.conv_id = n.conv_id AND c.turn > n.turn""",
        ),
        "context_entities": (
            turns(context_entities),
            f"""WITH {_MENTIONS}, f AS (SELECT conv_id, entity, count(*) AS frequency, max(turn) AS seen FROM m GROUP BY ALL), l AS (SELECT conv_id, max(turn) AS "end" FROM conversations GROUP BY 1),
            t AS (SELECT conv_id, max(frequency) AS top FROM f GROUP BY 1),
            s AS (SELECT f.conv_id, entity, frequency, greatest(0.0::DOUBLE, 1 - 0.15::DOUBLE * ("end" - seen)) AS recency, round(0.6::DOUBLE * greatest(0.0::DOUBLE, 1 - 0.15::DOUBLE * ("end" - seen)) + 0.4::DOUBLE * frequency / top, 4) AS salience FROM f JOIN l USING (conv_id) JOIN t USING (conv_id)),
            r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY salience DESC, entity)::INT AS rank, entity, frequency, round(recency, 4) AS recency, salience FROM s)
            SELECT * FROM r WHERE rank <= 5""",
        ),
    }
