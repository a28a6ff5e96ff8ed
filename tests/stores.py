"""A store with a scheme of its own, whose files no local path names."""

import os

from pyarrow import fs


def store(uri: str):
    """store://name/path lies below $TALATA_TEST_STORE/name."""
    assert uri.startswith("store://"), uri
    return fs.SubTreeFileSystem(os.environ["TALATA_TEST_STORE"], fs.LocalFileSystem()), uri.removeprefix("store://")
