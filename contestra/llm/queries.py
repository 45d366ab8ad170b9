"""The queries that apply each operator to its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from .ann import op7_ann
from .brown import op2_brown
from .graph_dedup import op10_graph_dedup
from .line_dedup import op3_line_dedup
from .mixing import op4_mixing
from .packing import op9_packing
from .sharding import op5_sharding
from .simhash import op6_simhash
from .tool_calls import OP1_SQL, op1_tool_calls
from .toxicity import op8_toxicity

QUERIES = {f.__name__: f for f in (op1_tool_calls, op2_brown, op3_line_dedup, op4_mixing, op5_sharding, op6_simhash, op7_ann, op8_toxicity, op9_packing, op10_graph_dedup)}

ORACLES = {"op1_tool_calls": OP1_SQL}
