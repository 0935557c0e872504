"""Java-style property files of compressed graphs."""

from __future__ import annotations

import os

GRAPH_TYPES = {"wg400": (4, 0), "wg800": (8, 0), "wg404": (4, 4)}


def parse_properties(text: str) -> dict[str, str]:
    """key=value or key:value lines; lines that start with # or ! are comments."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        line = line.strip()
        if not line or line[0] in "#!":
            continue
        cut = min((i for i in (line.find("="), line.find(":")) if i >= 0), default=len(line))
        out[line[:cut].strip()] = line[cut + 1 :].strip()
    return out


def read_properties(base: str) -> dict[str, str]:
    with open(f"{base}.properties", encoding="latin-1") as f:
        return parse_properties(f.read())


def underlying(base: str) -> str:
    """Base path of the graph that a labelled graph refers to, relative to its own folder."""
    name = read_properties(base).get("underlyinggraph")
    if not name:
        raise ValueError(f"{base}.properties names no underlying graph")
    return name if os.path.isabs(name) else os.path.join(os.path.dirname(base), name)


def check_files(base: str, graph_type: str) -> str:
    """Checks that the type is known and its files exist; returns the base of the .graph file."""
    if graph_type not in GRAPH_TYPES:
        raise ValueError(f"unknown graph type {graph_type!r}")
    need = [f"{base}.properties"]
    graph = base
    if graph_type == "wg404":
        need += [f"{base}.labels", f"{base}.labeloffsets"]
        if os.path.exists(need[0]):
            graph = underlying(base)
            need.append(f"{graph}.properties")
    need.append(f"{graph}.graph")
    missing = [p for p in need if not os.path.exists(p)]
    if missing:
        raise FileNotFoundError(", ".join(missing))
    kind = (read_properties(graph).get("graphclass") or "BVGraph").rpartition(".")[2].split()[-1]
    if kind != "BVGraph":
        raise ValueError(f"{graph} is a {kind}: only BVGraph files can be read at any vertex")
    return graph
