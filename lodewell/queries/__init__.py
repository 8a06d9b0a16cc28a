"""The catalogue's queries, by area; importing this package registers them all."""

from lodewell.queries import codenav, consolidation, graphs, indexes, integrity, keeping, knowledge, lifecycles, recall, relations, telemetry, temporal, texts  # noqa: F401
