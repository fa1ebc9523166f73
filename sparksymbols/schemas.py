"""Schemas of the stored tables. Spark types cannot be recursive, so nesting is bounded:
file -> export -> member -> signature -> overload."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


STRING, INT, LONG, BOOL, TS = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampType()

PARAMETER = _struct(
    ("name", STRING), ("type", STRING), ("required", BOOL), ("defaultValue", STRING), ("description", STRING)
)

_SIGNATURE_FIELDS = (
    ("parameters", T.ArrayType(PARAMETER)),
    ("returnType", STRING),
    ("isAsync", BOOL),
    ("isGenerator", BOOL),
)
OVERLOAD = _struct(*_SIGNATURE_FIELDS)
FUNCTION_SIGNATURE = _struct(*_SIGNATURE_FIELDS, ("overloads", T.ArrayType(OVERLOAD)))

MEMBER = _struct(
    ("name", STRING), ("type", STRING), ("visibility", STRING), ("lineNumber", INT), ("functionSignature", OVERLOAD),
    ("required", BOOL),
)
CLASS_INFO = _struct(
    ("extends", STRING),
    ("implements", T.ArrayType(STRING)),
    ("methods", T.ArrayType(MEMBER)),
    ("properties", T.ArrayType(MEMBER)),
    ("constructors", T.ArrayType(MEMBER)),
)
_DICTS = T.ArrayType(T.MapType(STRING, STRING))
INTERFACE_INFO = _struct(
    ("extends", T.ArrayType(STRING)),
    ("methods", T.ArrayType(MEMBER)),
    ("properties", T.ArrayType(MEMBER)),
    ("indexSignatures", _DICTS),
    ("callSignatures", _DICTS),
)
EXPORT = _struct(
    ("name", STRING),
    ("type", STRING),
    ("visibility", STRING),
    ("lineNumber", INT),
    ("functionSignature", FUNCTION_SIGNATURE),
    ("classInfo", CLASS_INFO),
    ("interfaceInfo", INTERFACE_INFO),
)
IMPORT = _struct(("name", STRING), ("source", STRING), ("lineNumber", INT))

FILE_INDEX = _struct(
    ("repoId", STRING),
    ("filePath", STRING),
    ("fileHash", STRING),
    ("lastCommitSHA", STRING),
    ("lastCommitTimestamp", TS),
    ("exports", T.ArrayType(EXPORT)),
    ("imports", T.ArrayType(IMPORT)),
    ("updatedAt", TS),
    ("language", STRING),
    ("parseErrors", T.ArrayType(STRING)),
)
REPOSITORY = _struct(
    ("repoId", STRING),
    ("name", STRING),
    ("url", STRING),
    ("lastProcessedCommit", STRING),
    ("lastProcessedCommitTimestamp", TS),
    ("totalFiles", LONG),
    ("processedFiles", LONG),
    ("lastUpdated", TS),
    ("status", STRING),
    ("errorMessage", STRING),
    ("failedFiles", LONG),
    ("progressPercentage", INT),
)
FILE_ROW = _struct(("repoId", STRING), ("filePath", STRING), ("content", STRING))
CHANGE_EVENT = _struct(
    ("repo_url", STRING),
    ("file_path", STRING),
    ("commit_sha", STRING),
    ("file_timestamp", TS),
    ("file_content", STRING),
    ("language", STRING),
)
LEASE_REQUEST = _struct(("lock_key", STRING), ("requested_at", TS), ("kind", STRING), ("ttl_seconds", INT))

FILE_KEY = ("repoId", "filePath")
