"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .chat import OP9_SQL, op9_chat
from .decontamination import OP3_SQL, op3_decontamination
from .langid import op7_langid
from .linededup import OP1_SQL, op1_linededup
from .lm import op4_lm
from .media import op10_media
from .mixing import op2_mixing
from .quality import op5_quality
from .sharding import op6_sharding
from .simhash import op8_simhash

QUERIES = {f.__name__: f for f in (op1_linededup, op2_mixing, op3_decontamination, op4_lm, op5_quality, op6_sharding, op7_langid, op8_simhash, op9_chat, op10_media)}
ORACLE_SQL = {"op1_linededup": OP1_SQL, "op3_decontamination": OP3_SQL, "op9_chat": OP9_SQL}
