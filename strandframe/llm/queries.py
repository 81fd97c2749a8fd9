"""The queries of this subpackage, as the driver calls them, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandframe.llm.chat import OP6_SQL, op6_chat
from strandframe.llm.decontaminate import op8_decontaminate
from strandframe.llm.langid import op2_langid
from strandframe.llm.licences import op10_licences
from strandframe.llm.neardup import op1_near_duplicates
from strandframe.llm.packing import op4_packing
from strandframe.llm.quality import OP9_SQL, op9_quality
from strandframe.llm.sharding import op7_sharding
from strandframe.llm.tokenids import op5_token_ids
from strandframe.llm.warc import OP3_SQL, op3_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_langid": op2_langid,
    "op3_warc": op3_warc,
    "op4_packing": op4_packing,
    "op5_token_ids": op5_token_ids,
    "op6_chat": op6_chat,
    "op7_sharding": op7_sharding,
    "op8_decontaminate": op8_decontaminate,
    "op9_quality": op9_quality,
    "op10_licences": op10_licences,
}

ORACLES: dict[str, str] = {"op3_warc": OP3_SQL, "op6_chat": OP6_SQL, "op9_quality": OP9_SQL}
