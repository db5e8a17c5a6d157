"""Files that tasks write and read in shared storage, by URI (file, hdfs, s3, gs: whatever Arrow's file systems open).

A task writes under a name of its own and returns it in a row; only names in
the materialised manifest count, so a repeated or lost attempt leaves at most
an unused file.
"""

import uuid

import pyarrow.fs as pafs


def _where(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def unique_name(folder: str, suffix: str) -> str:
    """A name that no other attempt uses."""
    return f"{folder}/{uuid.uuid4().hex}{suffix}"


def open_output(uri: str):
    """A writable stream; its folder is made if the file system has folders."""
    fs, path = _where(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return fs.open_output_stream(path, compression=None)


def open_input(uri: str):
    """A random-access file."""
    fs, path = _where(uri)
    return fs.open_input_file(path)
