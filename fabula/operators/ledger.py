"""Answers of a provider, kept by what was asked.

An answer is a small file under the digest of its request, in a folder that all executors share. It is
written under another name and renamed, so a file under a digest is whole; a repeated task, a
lost executor or a later run finds it and asks nobody. Only answers that were valid are kept. ``pyarrow.fs``
has to know the folder's scheme.
"""

from __future__ import annotations

import hashlib
import uuid

from pyarrow import fs


def fingerprint(*parts: str) -> str:
    """A digest of all parts; where one ends and the next begins is part of it."""
    return hashlib.sha256(b"".join(b"%d:%s" % (len(p.encode()), p.encode()) for p in parts)).hexdigest()


def write_whole(system: fs.FileSystem, path: str, data: bytes) -> None:
    """The file appears under its name when it is whole, in place of any of that name."""
    folder = path.rsplit("/", 1)[0]
    hidden = f"{folder}/.{uuid.uuid4().hex}"
    system.create_dir(folder, recursive=True)
    try:
        with system.open_output_stream(hidden) as out:
            out.write(data)
        system.move(hidden, path)
    except BaseException:
        if system.get_file_info(hidden).type != fs.FileType.NotFound:
            system.delete_file(hidden)
        raise


class Ledger:
    """``model`` names who answers, and in which version: another one is another request."""

    def __init__(self, folder: str, model: str = ""):
        self.folder, self.model = folder, model

    def _place(self, text: str, family: str) -> tuple[fs.FileSystem, str]:
        system, base = fs.FileSystem.from_uri(self.folder)
        digest = fingerprint(self.model, family, text)
        return system, f"{base}/{digest[:3]}/{digest}"

    def get(self, text: str, family: str) -> str | None:
        system, path = self._place(text, family)
        try:
            with system.open_input_stream(path, compression=None) as f:
                return f.read().decode()
        except FileNotFoundError:
            return None

    def put(self, text: str, family: str, answer: str) -> None:
        write_whole(*self._place(text, family), answer.encode())
