"""The star: eight tables, each built only when a report asks for it."""

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from tradeweave.operators import cleaning

Loader = Callable[[], DataFrame]


class Tables(Mapping[str, DataFrame]):
    """Named frames, made on first use and then kept (lazy plans, not data)."""

    def __init__(self, loaders: Mapping[str, Loader]):
        self._loaders = dict(loaders)
        self._frames: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self._loaders[name]()
        return self._frames[name]

    def __iter__(self):
        return iter(self._loaders)

    def __len__(self) -> int:
        return len(self._loaders)


class Star(Tables):
    """``fact_*`` and ``dim_*`` frames under short names.

    ``dealt``: the facts are stored dealt by order, so nothing has to be shuffled by it.
    """

    def __init__(self, loaders: Mapping[str, Loader], *, dealt: bool = False):
        super().__init__(loaders)
        self.dealt = dealt

    customers = property(lambda self: self["dim_customers"])
    products = property(lambda self: self["dim_products"])
    sellers = property(lambda self: self["dim_sellers"])
    geolocation = property(lambda self: self["dim_geolocation"])
    orders = property(lambda self: self["fact_orders"])
    order_items = property(lambda self: self["fact_order_items"])
    payments = property(lambda self: self["fact_payments"])
    reviews = property(lambda self: self["fact_reviews"])


def star_from_raw(raw: Mapping[str, DataFrame]) -> Star:
    """Cleans the nine raw tables into a star; nothing runs until a report is used."""
    return Star(
        {
            "dim_customers": lambda: cleaning.clean_customers(raw["customers"]),
            "dim_products": lambda: cleaning.clean_products(
                raw["products"], raw["category_translation"]
            ),
            "dim_sellers": lambda: cleaning.clean_sellers(raw["sellers"]),
            "dim_geolocation": lambda: cleaning.clean_geolocation(raw["geolocation"]),
            "fact_orders": lambda: cleaning.clean_orders(raw["orders"]),
            "fact_order_items": lambda: cleaning.clean_order_items(raw["order_items"]),
            "fact_payments": lambda: cleaning.clean_payments(raw["payments"]),
            "fact_reviews": lambda: cleaning.clean_reviews(raw["reviews"]),
        }
    )
