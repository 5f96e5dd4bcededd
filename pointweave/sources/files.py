"""Files by URI inside tasks, with seeking; any file system that pyarrow knows, by the URI that Spark gives."""

from __future__ import annotations

import re

from pyarrow import fs


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path on it). Spark writes local URIs with one slash or three."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))
