"""Small control files of the driver: atomic writes, bounded reads, checkpoints of stages, a job queue, cached batches.

These hold metadata of a run, never data; data goes through Spark's own committers.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
import time
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from io import BufferedIOBase
from typing import Any


def atomic_write(path: str, content: str | bytes) -> None:
    """Write a file so that a reader sees the old content or the new, never a part; folders are made."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    data = content.encode() if isinstance(content, str) else content
    handle, temporary = tempfile.mkstemp(dir=folder, prefix=".part-")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def atomic_write_json(path: str, data: Any) -> None:
    """A readable JSON file, written atomically; other characters than ASCII are kept."""
    atomic_write(path, json.dumps(data, ensure_ascii=False, indent=2, sort_keys=True) + "\n")


def read_bounded(stream: BufferedIOBase, limit: int) -> bytes:
    """All bytes of a stream, or an error as soon as there are more than `limit`."""
    data = stream.read(limit + 1)
    if len(data) > limit:
        raise ValueError(f"more than {limit} bytes")
    return data


def parse_structured(text: str) -> Any:
    """The JSON value in a text: the whole, or in a fenced block, or from the first bracket to its match; else an error."""
    decoder = json.JSONDecoder()
    fenced = text.split("```")
    for part in [text, *(p.split("\n", 1)[-1] for p in fenced[1::2])]:
        try:
            return json.loads(part.strip())
        except ValueError:
            continue
    for i, c in enumerate(text):
        if c in "{[":
            try:
                return decoder.raw_decode(text, i)[0]
            except ValueError:
                continue
    raise ValueError("no JSON value in the text")


class StageCheckpoint:
    """Which stages of a run are complete; kept in one file, so that a run goes on where it stopped. A broken file starts anew."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.state: dict[str, Any] = {"completed": [], "metadata": {}}
        if os.path.exists(path):
            try:
                with open(path) as f:
                    self.state |= json.load(f)
            except ValueError:
                pass

    def is_complete(self, stage: str) -> bool:
        return stage in self.state["completed"]

    def mark_complete(self, stage: str, metadata: dict | None = None) -> None:
        if not self.is_complete(stage):
            self.state["completed"].append(stage)
        if metadata:
            self.state["metadata"][stage] = metadata
        atomic_write_json(self.path, self.state)

    def run(self, stages: Sequence[tuple[str, Callable[[], dict | None]]]) -> list[str]:
        """Run the stages that are not complete, in order; the names of those that ran."""
        ran = []
        for name, work in stages:
            if not self.is_complete(name):
                self.mark_complete(name, work())
                ran.append(name)
        return ran


@dataclass
class Job:
    """One request of a queue."""

    job_id: str
    payload: dict = field(default_factory=dict)
    status: str = "pending"
    attempts: int = 0
    claimed_at: float | None = None
    error: str | None = None


class JobQueue:
    """Jobs as files in folders by state; a job is claimed by renaming its file, which one claimer alone can do."""

    STATES = ("pending", "running", "done", "failed")

    def __init__(self, root: str, max_attempts: int = 3) -> None:
        self.root, self.max_attempts = root, max_attempts
        for s in self.STATES:
            os.makedirs(os.path.join(root, s), exist_ok=True)

    def _path(self, state: str, job_id: str) -> str:
        return os.path.join(self.root, state, f"{job_id}.json")

    def put(self, job: Job) -> bool:
        """Add a job unless one of its id is known."""
        if any(os.path.exists(self._path(s, job.job_id)) for s in self.STATES):
            return False
        atomic_write_json(self._path("pending", job.job_id), asdict(job))
        return True

    def jobs(self, state: str) -> list[Job]:
        """Jobs of a state in order of their ids."""
        folder, out = os.path.join(self.root, state), []
        for name in sorted(os.listdir(folder)):
            if name.endswith(".json"):
                with open(os.path.join(folder, name)) as f:
                    out.append(Job(**json.load(f)))
        return out

    def _move(self, job: Job, source: str, target: str) -> None:
        job.status = target
        atomic_write_json(self._path(source, job.job_id), asdict(job))
        os.replace(self._path(source, job.job_id), self._path(target, job.job_id))

    def claim(self) -> Job | None:
        """The first pending job, now running; None if there is none."""
        for job in self.jobs("pending"):
            try:
                os.rename(self._path("pending", job.job_id), self._path("running", job.job_id))
            except FileNotFoundError:
                continue
            job.status, job.attempts, job.claimed_at = "running", job.attempts + 1, time.time()
            atomic_write_json(self._path("running", job.job_id), asdict(job))
            return job
        return None

    def finish(self, job: Job, error: str | None = None) -> None:
        """Done, or pending again after an error, or failed after too many."""
        job.error = error
        self._move(job, "running", "done" if error is None else "failed" if job.attempts >= self.max_attempts else "pending")

    def recover(self, older_than: float) -> int:
        """Put running jobs that were claimed so many seconds ago back; how many."""
        stale = [j for j in self.jobs("running") if (j.claimed_at or 0) < time.time() - older_than]
        for j in stale:
            self._move(j, "running", "pending")
        return len(stale)


def batch_key(kind: str, items: Iterable[Any], version: str = "1") -> str:
    """Key of a batch's result: the digest of its kind, version and items."""
    return hashlib.sha256(json.dumps([kind, version, list(items)], ensure_ascii=False, sort_keys=True).encode()).hexdigest()


def run_batches(work: Callable[[list], Any], items: Sequence, size: int, workers: int, cache: str | None = None, kind: str = "batch") -> list[Any]:
    """Results of the batches of `items`, in order, at most `workers` at once; with `cache`, a batch that is there is not run again."""

    def one(batch: list) -> Any:
        path = os.path.join(cache, batch_key(kind, batch) + ".json") if cache else None
        if path and os.path.exists(path):
            with open(path) as f:
                return json.load(f)
        result = work(batch)
        if path:
            atomic_write_json(path, result)
        return result

    batches = [list(items[i : i + size]) for i in range(0, len(items), size)]
    with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
        return list(pool.map(one, batches))


def collect_garbage(folder: str, referenced: set[str], dry_run: bool = False) -> list[str]:
    """Entries of a cache folder that nothing refers to, removed unless `dry_run`."""
    unused = sorted(n for n in (os.listdir(folder) if os.path.isdir(folder) else []) if n not in referenced)
    for n in [] if dry_run else unused:
        path = os.path.join(folder, n)
        shutil.rmtree(path) if os.path.isdir(path) else os.unlink(path)
    return unused


def seal(path: str) -> dict[str, Any]:
    """Size and digest by which a file that must not change is known again."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return {"bytes": os.path.getsize(path), "sha256": h.hexdigest()}


def seal_holds(path: str, expected: dict[str, Any]) -> bool:
    return os.path.exists(path) and seal(path) == expected


class RecentResults:
    """The results of the last queries, the least recently used leaving first."""

    def __init__(self, size: int = 128) -> None:
        self.size, self.held = size, {}

    def get(self, key: str, compute: Callable[[], Any]) -> Any:
        if key in self.held:
            self.held[key] = self.held.pop(key)
            return self.held[key]
        value = self.held[key] = compute()
        if len(self.held) > self.size:
            self.held.pop(next(iter(self.held)))
        return value
