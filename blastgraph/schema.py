"""Names and fixed values of the graph model."""

from __future__ import annotations

#: End of a window that is still open: 2100-01-01T00:00:00Z in epoch seconds. Storage has no nulls.
OPEN_END = 4_102_444_800

LABELS = ("Package", "Release", "Maintainer", "Service", "Lockfile", "Advisory")
VERSION_OF, DEPENDS_ON, DEV_DEPENDS_ON = "VERSION_OF", "DEPENDS_ON", "DEV_DEPENDS_ON"
CAN_PUBLISH, PUBLISHED, USES_LOCKFILE, PINS, AFFECTS = "CAN_PUBLISH", "PUBLISHED", "USES_LOCKFILE", "PINS", "AFFECTS"
RELATIONSHIPS = (VERSION_OF, DEPENDS_ON, DEV_DEPENDS_ON, CAN_PUBLISH, PUBLISHED, USES_LOCKFILE, PINS, AFFECTS)

#: Strongest first: where a dependency is declared twice, the first of these stands.
KIND_ORDER = ("runtime", "peer", "optional", "dev")

#: Caps of the resolver and of the traversals.
CANDIDATE_VERSIONS, WINDOWS_PER_DEPENDENCY, VERSIONS_KEPT = 60, 5, 40
BLAST_HOPS, REACH_HOPS, UPGRADE_HOPS = 8, 6, 4
BLAST_PATHS, UPGRADE_PATHS, BASELINE_PATHS = 4000, 800, 500
