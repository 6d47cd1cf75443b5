"""What kind of place a path names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes and kinds, the first that fits wins.
PREFIXES = [("/Volumes/", "VOLUME"), ("dbfs:/", "DBFS"), ("/dbfs/", "DBFS"), ("abfss://", "AZURE"), ("wasbs://", "AZURE"), ("/Workspace/", "WORKSPACE")]


def path_kind(path: Column) -> Column:
    out = F.when(path.startswith(PREFIXES[0][0]), PREFIXES[0][1])
    for prefix, kind in PREFIXES[1:]:
        out = out.when(path.startswith(prefix), kind)
    return out.otherwise("LOCAL")
