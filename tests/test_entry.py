from __future__ import annotations

import zipfile
from pathlib import Path
from types import SimpleNamespace

import __spark_entry__ as entry


def test_modules_stay_for_executors_that_fetch_them_later():
    sent: list[str] = []

    def session(application: str):
        return SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077", applicationId=application, environment={}, addPyFile=sent.append))

    for application in ("app-1", "app-1", "app-2"):  # another application has no copy yet
        entry.ready(session(application))
    assert len(sent) == 2 and all(Path(p).is_file() for p in sent)
    names = set(zipfile.ZipFile(sent[-1]).namelist())
    assert {"__spark_entry__.py", "corpus_pipeline.py", "brinewave/plans/queries.py", "brinewave/llm/op7_minhash_dedup.py"} <= names
