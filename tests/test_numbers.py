"""Numbers of rows without a natural key."""

import datetime
import random
from decimal import Decimal

from tradeweave.operators import quality
from tradeweave.plans.star import Star
from tradeweave.schemas import STAR

DAY = datetime.datetime(2020, 1, 1)


def test_every_item_is_numbered_in_the_order_of_its_columns(spark):
    draw = random.Random(3)
    items = [
        (f"o{draw.randrange(40)}", draw.randint(1, 3), f"p{draw.randrange(5)}", "s", DAY, Decimal(draw.randrange(9)), Decimal(1), Decimal(2))
        for _ in range(400)
    ]
    items += items[:50] + [(None, 1, None, None, None, None, None, None)] * 2
    star = Star({"fact_order_items": lambda: spark.createDataFrame(items, STAR["fact_order_items"]).repartition(7)})
    found = sorted(quality.surrogate_keys(star).collect(), key=lambda r: r["item_id"])
    assert [r["item_id"] for r in found] == list(range(1, len(items) + 1))
    rows = [tuple(r)[:8] for r in (r.asDict().values() for r in found)]
    assert rows == sorted(items, key=lambda r: [(v is None, v if v is not None else 0) for v in r])
