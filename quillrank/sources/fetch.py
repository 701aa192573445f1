"""Driver-side utilities around raw archives: checksums, extraction, discovery, manifest."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import time
import urllib.request
import zipfile
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import urlsplit


@dataclass(frozen=True)
class Source:
    id: str
    url: str
    dataset: str
    group: str = "core"
    markers: tuple[str, ...] = ()
    sha256: str = ""


def select_sources(sources: list[Source], ids: list[str] | None = None, group: str = "core", dataset: str | None = None) -> list[Source]:
    """By id if any are given, else by group (``all`` for every one) and dataset."""
    if ids:
        known = {s.id: s for s in sources}
        if unknown := sorted(set(ids) - set(known)):
            raise SystemExit(f"unknown sources {unknown}; known: {sorted(known)}")
        return [known[i] for i in ids]
    return [s for s in sources if group in ("all", s.group) and dataset in (None, s.dataset)]


def is_ready(root: Path, source: Source) -> bool:
    """Whether all marker files are there, so the source need not be fetched again."""
    return bool(source.markers) and all((root / m).exists() for m in source.markers)


def sha256_of(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def find_token(file: Path | None = None, variable: str = "SOURCE_TOKEN") -> str | None:
    """The access token from the environment, else from a file, else none."""
    if token := os.environ.get(variable, "").strip():
        return token
    return file.read_text(encoding="utf-8").strip() or None if file and file.exists() else None


class _KeepAtHome(urllib.request.HTTPRedirectHandler):
    """Redirects take the token along to the same host only."""

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        new = super().redirect_request(req, fp, code, msg, headers, newurl)
        token = req.unredirected_hdrs.get("Authorization")
        if new is not None and token and urlsplit(newurl).hostname == urlsplit(req.full_url).hostname:
            new.add_unredirected_header("Authorization", token)
        return new


def download(url: str, target: Path, token: str | None = None, attempts: int = 3) -> Path:
    """Fetch with resumption of a partial file; the token is only shown to the host of ``url``."""
    part = target.with_name(target.name + ".part")
    opener = urllib.request.build_opener(_KeepAtHome())
    for attempt in range(attempts):
        start = part.stat().st_size if part.exists() else 0
        request = urllib.request.Request(url, headers={"Range": f"bytes={start}-"} if start else {})
        if token:
            request.add_unredirected_header("Authorization", f"Bearer {token}")
        try:
            with opener.open(request, timeout=60) as reply, part.open("ab" if start and reply.status == 206 else "wb") as out:
                shutil.copyfileobj(reply, out)
            part.replace(target)
            return target
        except OSError:
            if attempt == attempts - 1:
                raise
            time.sleep(2**attempt)
    return target


def fetch_sources(sources: list[Source], root: Path, token: str | None = None, force: bool = False) -> list[dict]:
    """Download, check and unpack sources into ``root/dataset``; one status row for each.

    A source whose markers are there is ``ready`` and not fetched again; an archive whose
    checksum differs from the stated one is deleted before it is unpacked. One
    source's failure does not stop the others. The manifest lists what was unpacked.
    """
    table, files = [], []
    for source in sources:
        folder = Path(root) / source.dataset
        row = {"id": source.id, "dataset": source.dataset, "group": source.group, "folder": str(folder)}
        if not force and is_ready(folder, source):
            table.append(row | {"status": "ready"})
            continue
        folder.mkdir(parents=True, exist_ok=True)
        archive = folder / f"{source.id}.zip"
        try:
            download(source.url, archive, token)
            if source.sha256 and sha256_of(archive) != source.sha256:
                status = "failed: checksum"
            else:
                files += extract(archive, folder)
                status = "fetched" if is_ready(folder, source) or not source.markers else "failed: incomplete"
        except (OSError, ValueError, zipfile.BadZipFile) as e:
            status = f"failed: {type(e).__name__}"
        archive.unlink(missing_ok=True)
        table.append(row | {"status": status})
    if files:
        write_manifest(Path(root).resolve(), [f for f in files if f.exists()])
    return table


def extract(archive: Path, target: Path) -> list[Path]:
    """Unpack a zip safely: no path leaves ``target``, one common top folder is dropped."""
    target = target.resolve()
    done = []
    with zipfile.ZipFile(archive) as z:
        names = [n for n in z.namelist() if not n.endswith("/") and "__MACOSX" not in n.split("/")]
        tops = {n.split("/")[0] for n in names}
        strip = len(tops) == 1 and all("/" in n for n in names)
        for n in names:
            place = (target / (n.split("/", 1)[1] if strip else n)).resolve()
            if not place.is_relative_to(target):
                raise ValueError(f"unsafe path in archive: {n}")
            place.parent.mkdir(parents=True, exist_ok=True)
            with z.open(n) as a, place.open("wb") as b:
                shutil.copyfileobj(a, b)
            done.append(place)
    return done


def enough_disk(root: Path, needed_bytes: int) -> bool:
    return shutil.disk_usage(root).free >= needed_bytes


def write_manifest(root: Path, files: list[Path]) -> Path:
    entries = [{"path": str(f.relative_to(root)), "bytes": f.stat().st_size, "sha256": sha256_of(f)} for f in sorted(files)]
    out = root / "manifest.json"
    out.write_text(json.dumps(entries, indent=2), encoding="utf-8")
    return out


def find_folder(root: Path, needed: list[str], prefer: str | None = None) -> Path:
    """A folder below ``root`` that holds all ``needed`` names: the one called ``prefer``, which must be there.

    Without a name one called ``test`` comes first, then the first by path.
    """
    found = sorted({p.parent for p in root.rglob(needed[0]) if all((p.parent / n).exists() for n in needed)})
    named = [p for p in found if p.name == (prefer or "test")]
    if not found or (prefer and not named):
        raise FileNotFoundError(f"no folder {prefer or ''} with {needed} below {root}")
    return (named or found)[0]


def find_articles(root: Path, names: tuple[str, ...] = ("articles.parquet", "news.tsv")) -> Path:
    """The article file below ``root`` nearest to it."""
    found = sorted((p for n in names for p in root.rglob(n)), key=lambda p: (len(p.parts), str(p)))
    if not found:
        raise FileNotFoundError(f"none of {names} below {root}")
    return found[0]
