"""Plans: the whole way from requests to links, and the queries that stand for each operator."""

from .link import Options, collect_json, inspect, link

__all__ = ["Options", "collect_json", "inspect", "link"]
