"""Stored tables: who owns them, and that queries at the same time don't remove each other's."""

import os
import threading

from heddle.operators.lexical import sparse_search_batch
from heddle.session import Scope, Stored


def there(stored):
    return os.path.exists(stored.path.removeprefix("file://"))


def test_a_scope_removes_what_was_stored_in_it(spark):
    outside = Stored(spark.range(3))
    with Scope() as around:
        with Scope() as scope:
            gone, kept = Stored(spark.range(4)), scope.keep(Stored(spark.range(5)))
        assert not there(gone) and there(kept) and kept.df.count() == 5 and around.made == [kept]
    assert not there(kept) and there(outside) and outside.df.count() == 3
    outside.drop()
    assert not there(outside)


def test_a_failing_query_leaves_nothing(spark):
    made = []
    try:
        with Scope():
            made.append(Stored(spark.range(2)))
            raise RuntimeError("no")
    except RuntimeError:
        pass
    assert not there(made[0])


def test_scopes_of_different_threads_dont_meet(spark):
    ready, done, seen = threading.Event(), threading.Event(), []

    def other():
        with Scope():
            own = Stored(spark.range(7))
            ready.set()
            done.wait(60)
            seen.append((there(own), own.df.count()))

    worker = threading.Thread(target=other)
    worker.start()
    ready.wait(60)
    with Scope():
        mine = Stored(spark.range(2))
    done.set()
    worker.join()
    assert seen == [(True, 7)] and not there(mine)


def test_a_query_in_a_scope_leaves_nothing_behind(spark):
    docs = spark.createDataFrame([(i, f"word{i % 3} common") for i in range(9)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "word1 common")], "query_id long, question string")
    with Scope() as scope:
        rows = sparse_search_batch(docs, asked, 2).collect()
        assert len(rows) == 2 and scope.made
    assert not any(map(there, scope.made))
