"""Project configuration and workspace manifests (TOML)."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

#: Files that tell a project's language.
MARKERS = {
    "typescript": ("tsconfig.json", "package.json"), "csharp": ("*.csproj", "*.sln"), "python": ("pyproject.toml", "setup.py", "requirements.txt", "Pipfile"),
    "go": ("go.mod",), "java": ("pom.xml", "build.gradle", "build.gradle.kts", "src/main/java"), "rust": ("Cargo.toml",),
}


@dataclass
class Project:
    name: str
    languages: list[str] = field(default_factory=list)
    ignore: list[str] = field(default_factory=list)
    vendor_patterns: list[str] = field(default_factory=list)


@dataclass
class Member:
    path: str
    name: str


def read_project(path: str) -> Project:
    data = tomllib.loads(Path(path).read_text())
    index = data.get("index", {})
    return Project(data.get("project", {}).get("name", ""), data.get("project", {}).get("languages", []), index.get("ignore", []), index.get("vendor_patterns", []))


def detect_languages(root: str) -> list[str]:
    """Languages whose marker files root holds."""
    return [k for k, names in MARKERS.items() if any(any(True for _ in Path(root).glob(n)) for n in names)]


def read_workspace(path: str) -> list[Member]:
    """Members of a workspace manifest; raises ValueError if names clash, folders are missing, outside, or inside one another."""
    data, root = tomllib.loads(Path(path).read_text()), Path(path).resolve().parent
    info = data.get("workspace", data)
    if int(info.get("version", 1)) > 1:
        raise ValueError(f"unknown version {info['version']}")
    members = [Member(m["path"], m.get("name") or Path(m["path"]).name) for m in data.get("members", info.get("members", []))]
    places = [(root / m.path).resolve() for m in members]
    if len({m.name for m in members}) < len(members):
        raise ValueError("two members have the same name")
    for m, p in zip(members, places):
        if not p.is_dir() or not p.is_relative_to(root):
            raise ValueError(f"no folder of the workspace: {m.path}")
        if any(p != q and p.is_relative_to(q) for q in places):
            raise ValueError(f"inside another member: {m.path}")
    return members


def write_workspace(path: str, name: str, members: list[Member]) -> None:
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    rows = "".join(f"\n[[members]]\npath = {quote(m.path)}\nname = {quote(m.name)}\n" for m in sorted(members, key=lambda m: m.path))
    Path(path).write_text(f"[workspace]\nname = {quote(name)}\nversion = 1\n{rows}")
