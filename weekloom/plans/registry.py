"""All registered queries: importing the modules below adds theirs."""
from weekloom.plans import alignment, decisions, keyless, learning, records, scoring, streams, texts
from weekloom.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "alignment", "decisions", "keyless", "learning", "records", "scoring", "streams", "texts"]
