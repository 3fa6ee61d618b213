"""Small documents for engine tests."""

from skein.access import Access
from skein.model import INCOMING, SearchRequest

FIELDS = [x.split()[0] for x in INCOMING.split(", ")]
ME = Access(viewer="ann")


def doc(name, title="", content="", owner="ann", **more):
    base = dict.fromkeys(FIELDS) | {"provider_id": "files", "document_id": name, "owner": owner, "title": title, "content": content, "modified_time": 1_700_000_000}
    return base | more


def frame(spark, docs):
    return spark.createDataFrame([tuple(d[f] for f in FIELDS) for d in docs], INCOMING)


def ids(engine, text="", access=ME, **more):
    result = engine.search(SearchRequest(text, provider="files", **more), access)
    return [d["document_id"] for d in result.documents]
