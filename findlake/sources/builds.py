"""Dependencies that Maven builds declare. A parser for `parsers.parse`."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

DECLARES = ("dependency", "plugin", "extension")
ROUNDS = 5


def maven_versions(text: str) -> Iterator[tuple]:
    """coordinate, raw, version, snapshots_count of each dependency, plugin or extension with a version; none of what is no project.

    Properties of the file are put in, to a depth of five. Snapshots count in a build that is known to be a release, but
    for those of its own group.
    """
    try:
        root = ElementTree.fromstring(text)
    except (ElementTree.ParseError, ValueError):
        return
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    if root.tag != "project":
        return
    said = lambda e, path: (e.findtext(path) or "").strip()
    properties = {c.tag: (c.text or "").strip() for c in root.find("properties") or ()}
    version = said(root, "version") or said(root, "parent/version")
    properties = {"project.version": version, "version": version, "project.parent.version": said(root, "parent/version")} | properties

    def filled(value: str) -> str:
        for _ in range(ROUNDS):
            value = re.sub(r"\$\{([^}]+)\}", lambda m: properties.get(m[1], m[0]), value)
        return value

    release = bool(filled(version)) and "$" not in filled(version) and not filled(version).upper().endswith("-SNAPSHOT")
    group = said(root, "groupId") or said(root, "parent/groupId")
    for e in root.iter():
        if e.tag in DECLARES and e.find("version") is not None:
            theirs = filled(said(e, "groupId"))
            sibling = bool(group) and (theirs + ".").startswith(group + ".")
            yield f"{said(e, 'groupId')}:{said(e, 'artifactId')}".strip(":"), said(e, "version"), filled(said(e, "version")), release and not sibling
