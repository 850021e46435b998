"""Schemas and the fixed codes of the data model."""

from __future__ import annotations

from pyspark.sql import types as T


TYPES = {
    "string": T.StringType(), "binary": T.BinaryType(), "smallint": T.ShortType(), "int": T.IntegerType(),
    "bigint": T.LongType(), "double": T.DoubleType(),
}


def struct(spec: str) -> T.StructType:
    """``name type, ..`` of plain types; usable before there is a session."""
    return T.StructType([T.StructField(n, TYPES[t]) for n, t in (f.split() for f in spec.split(","))])


STAT = struct(
    "scope string, dateissued string, hourissued string, timeissued bigint, level string, "
    "id string, key string, unit string, frame int, val double, label string"
)
STAT_RESULT = T.StructType([*STAT.fields, *struct("ilevel string, iid string, iclass smallint").fields])
ALARM = struct(
    "scope string, alarmid string, ccid string, state int, smode int, variables string, "
    "dateissued string, hourissued string, timecleared bigint, timeissued bigint, type int, "
    "sortorder int, pmode int, level1 string, id1 string, level2 string, id2 string, tmode int, "
    "severity int, text string, comment string, origmsg string"
)
INV_NODE = struct("level string, id string, key string, val string")
INV_EDGE = struct("level1 string, id1 string, level2 string, id2 string, key string, val string")
INV_MAP = INV_EDGE
INV_CC = struct("ndlevel string, ndid string, cclevel string, ccid string, ndn bigint")
LEVEL_NODE = struct("id string, name string, class int")
LEVEL_MAP = struct("id1 string, id2 string, index int, dir int, iid1 string, iid2 string, orig int")
FLOW = struct(
    "src_addr string, dst_addr string, hop string, input int, output int, packets bigint, "
    "bytes bigint, first bigint, last bigint, src_port int, dst_port int, tcp_flags int, "
    "protocol int, tos int, src_as bigint, dst_as bigint, src_mask int, dst_mask int"
)
KEYED_FRAME = struct("key string, frame int, val double")

# Fixed values of the data model.
ALARM_TYPE = {"none": 0, "alarm": 1, "clear": 2}
ALARM_STATE = {"none": 0, "info": 1, "deg": 2, "down": 3, "up": 4}
ALARM_MODE = {"none": 0, "keep": 1, "defer": 2, "drop": 3}
SORT_ORDER = {"none": 0, "normal": 1, "override": 2}
PROCESS_MODE = {"none": 0, "process": 1, "passthrough": 2}
SEVERITY = {"critical": 1, "major": 2, "minor": 3, "warning": 4, "normal": 5}
MEAN_LABEL, SDEV_LABEL, PROJ_LABEL = "___mean___", "___sdev___", "___proj___"
