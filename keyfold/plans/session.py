"""Session settings that suit the join aggregate."""

from __future__ import annotations

#: Aggregation by a key of up to a few million values per task stays in the generated code's own hash map (2^22 slots);
#: adaptive execution coalesces small shuffle partitions and splits skewed ones.
RECOMMENDED = {
    "spark.sql.codegen.aggregate.fastHashMap.capacityBit": "22",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
