"""A support assistant's notes over half a year: store them, see what disagrees, settle it, look at the health.

    python examples/support_bot.py
"""

import datetime as dt
import tempfile

from loomary.evalsuite.cases import vector
from loomary.evalsuite.scenarios import newer_wins
from loomary.session import local_session
from loomary.sources.store import MemoryStore

NOTES = [
    ("returns-1", "Returns are taken within 30 days.", "refund return window", 180),
    ("plan-1", "The basic plan costs 9 a month.", "price plan", 150),
    ("api-1", "The limit is 100 requests a minute.", "api rate limit", 120),
    ("returns-2", "Returns are taken within 60 days.", "refund return window", 60),
    ("plan-2", "The basic plan costs 12 a month.", "price plan", 30),
]


def main() -> None:
    spark = local_session("support-bot", partitions=4)
    with MemoryStore(spark, f"file://{tempfile.mkdtemp()}/notes", classifier=newer_wins) as store:
        now = dt.datetime.now(dt.UTC)
        for mid, text, words, age in NOTES:
            at = now - dt.timedelta(days=age)
            store.store({"agent_id": "bot", "memory_id": mid, "text": text, "embedding": vector(*words.split()), "created_at": at, "updated_at": at})
        print("open conflicts")
        store.open_conflicts("bot").select("memory_a_id", "memory_b_id", "conflict_type", "confidence").show(truncate=False)
        print("what the bot would be told about returns")
        store.search("bot", vector("refund", "return"), 3).select("memory_id", "score", "conflict_flag", "recommended").show()
        store.consolidate("bot")
        print("lineage of the current note:", store.lineage("bot", "returns-2"))
        store.health("bot").select("total_memories", "stale_count", "freshness_score", "contradiction_score", "score", "risk_level").show()
    spark.stop()


if __name__ == "__main__":
    main()
