"""Where a repository comes from: a local folder, or a clone that git makes on the driver."""

from __future__ import annotations

import hashlib
import os
import re
import subprocess
from urllib.parse import urlsplit

SAFE = ("https", "ssh", "git+ssh")
_SCP = re.compile(r"([A-Za-z0-9_.-]+)@([A-Za-z0-9_.-]+):(.+)")


def kind(raw: str, allow_file: bool = False) -> str:
    """local or git; any other scheme is an error."""
    if re.match(r"[A-Za-z]:[\\/]", raw):
        return "local"
    if "://" in raw:
        scheme = raw.split("://", 1)[0].lower()
        if scheme in SAFE or scheme == "file" and allow_file:
            return "git"
        raise ValueError(f"scheme not allowed: {scheme}")
    return "git" if _SCP.fullmatch(raw) else "local"


def canonical(url: str) -> str:
    t = url.strip()
    if (m := _SCP.fullmatch(t)) and "://" not in t:
        t = f"ssh://{m[1]}@{m[2]}/{m[3].lstrip('/')}"
    p = urlsplit(t)
    if not p.scheme:
        raise ValueError("not a git URL")
    user, _, host = p.netloc.rpartition("@")
    if user and p.scheme.lower() in ("http", "https"):
        raise ValueError(f"credentials in a URL: {redact(url)}")
    return f"{p.scheme.lower()}://{user + '@' if user else ''}{host.lower()}{p.path.rstrip('/') or '/'}"


def redact(url: str) -> str:
    m = re.match(r"(https?://)[^/@]*@([^?#]*)", url)
    return f"{m[1]}***@{m[2]}" if m else url


def is_commit(ref: str) -> bool:
    return bool(re.fullmatch(r"[0-9a-fA-F]{7,40}", ref))


def _git(*args: str, at: str | None = None) -> str:
    done = subprocess.run(["git", *args], cwd=at, capture_output=True, text=True, env=os.environ | {"GIT_TERMINAL_PROMPT": "0"})
    if done.returncode:
        raise RuntimeError(f"git {args[0]} failed: {done.stderr.strip()[:300]}")
    return done.stdout.strip()


def cache_dir(url: str) -> str:
    """The folder name of a URL's clone: its last part and eight digits of its hash."""
    plain = canonical(url).removesuffix(".git")
    return f"{re.split(r'[/:]', plain)[-1]}_{hashlib.sha256(plain.encode()).hexdigest()[:8]}"


def checkout(url: str, cache: str, ref: str | None = None, refresh: bool = False, allow_file: bool = False) -> tuple[str, str]:
    """(folder, commit) of a clean worktree of the ref; the remote's state is preferred to an older local one."""
    if kind(url, allow_file) != "git":
        raise ValueError("not a git source")
    own = os.path.join(cache, cache_dir(url))
    if not os.path.isdir(os.path.join(own, ".git")):
        _git("clone", "--quiet", "--depth", "1", "--no-single-branch", url, own)
    elif refresh:
        _git("fetch", "--quiet", "--all", "--tags", at=own)
    if ref:
        names = (ref,) if is_commit(ref) else (f"origin/{ref}", ref)
        for name in names:
            try:
                _git("rev-parse", "--verify", "--quiet", f"{name}^{{commit}}", at=own)
            except RuntimeError:
                continue
            _git("checkout", "--quiet", "--detach", name, at=own)
            break
        else:
            try:  # the clone is shallow: an older commit is fetched on its own
                _git("fetch", "--quiet", "--depth", "1", "origin", ref, at=own)
            except RuntimeError:
                raise ValueError(f"no such ref: {ref}") from None
            _git("checkout", "--quiet", "--detach", "FETCH_HEAD", at=own)
    elif refresh:
        _git("checkout", "--quiet", "--detach", "origin/HEAD", at=own)
    _git("reset", "--quiet", "--hard", at=own)
    _git("clean", "-fdq", at=own)
    return own, _git("rev-parse", "HEAD", at=own)


def local(path: str) -> str:
    full = os.path.abspath(os.path.expanduser(path))
    if not os.path.exists(full):
        raise FileNotFoundError(full)
    if not os.path.isdir(full):
        raise NotADirectoryError(full)
    return full
