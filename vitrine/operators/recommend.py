"""Products bought together, and the usual products of each customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from vitrine.operators.lookup import few_variant_names, keys, pin, variant_names

# Item rows of an order that are gathered in one basket; larger orders are paired by chunks.
BLOCK = 256
# Pairs that one task lists and counts, at most by estimate: some 150 bytes each.
TASK_PAIRS = 2_000_000
# Variants whose pairs set the bar for the most frequent pairs.
SEEDS = 1000
# Items are thinned before pairing if no more than this share of them stays; a
# lower bar drops too little to be worth a look.
WORTHWHILE_SHARE = 0.5
WORTHWHILE_BAR = 10
# Up to so many product ids are broadcast to thin the items where they are read.
BROADCAST_PRODUCTS = 500_000
# Up to so many orders of one customer (some 20 bytes each) are broadcast to the items.
BROADCAST_ORDERS = 500_000


def basket_items(items: DataFrame) -> DataFrame:
    """Each variant once per order, nulls left out."""
    return (
        items.filter(F.col("order_id").isNotNull() & F.col("product_variant_id").isNotNull())
        .select("order_id", "product_variant_id")
        .distinct()
    )


def order_baskets(items: DataFrame) -> DataFrame:
    """Sorted distinct variants of each order.

    Repeats collapse within each task, so a basket is at most as long as the
    catalogue, however many item rows its order has. An order whose variants
    are all null has an empty basket.
    """
    return (
        items.filter(F.col("order_id").isNotNull())
        .groupBy("order_id")
        .agg(F.array_sort(F.collect_set("product_variant_id")).alias("produtos"))
    )


def _listed_pairs(baskets: DataFrame, firsts: int) -> DataFrame:
    """Pairs of each of the first ``firsts`` products of a basket with those after it."""
    heads = baskets.select(
        "produtos", F.posexplode(F.slice("produtos", 1, firsts)).alias("_at", "produto_a")
    )
    later = F.slice("produtos", F.col("_at") + 2, F.size("produtos"))
    return heads.select("produto_a", F.explode(later).alias("produto_b"))


def _counted(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("produto_a", "produto_b").agg(F.count(F.lit(1)).alias("coocorrencias"))


def _by_size(items: DataFrame, block: int, pairs: int) -> tuple[DataFrame, DataFrame]:
    """Baskets of the orders with up to ``block`` item rows, and the distinct items of the others.

    Only orders of bounded size are gathered into a row. The baskets are dealt to so many tasks that
    none lists more than about :data:`TASK_PAIRS` of their ``pairs``: most pairs differ, so
    what a task counts grows with what it lists.
    """
    known = items.filter(
        F.col("order_id").isNotNull() & F.col("product_variant_id").isNotNull()
    ).select("order_id", "product_variant_id")
    above = known.groupBy("order_id").agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > block)
    above = above.select("order_id")
    usual = known.join(above, "order_id", "left_anti")
    tasks = -(-pairs // TASK_PAIRS)
    if tasks > 1:  # by a number of its own, as Spark drops a second shuffle into the same number and joins partitions of the first
        usual = usual.repartition(max(tasks, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1, "order_id")
    return order_baskets(usual), basket_items(known.join(above, "order_id", "left_semi"))


def _cell_pairs(large: DataFrame, block: int) -> DataFrame:
    """Pairs of large orders, listed by cells of two chunks of an order's items.

    An order is dealt by hash into chunks of about ``block`` / 2 items, and each two chunks meet
    in a row of their own, so that no row grows with the order.
    """
    chunk = max(1, block // 2)
    sizes = large.groupBy("order_id").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("_chunks"))
    dealt = large.join(sizes, "order_id").withColumn(
        "_own", F.pmod(F.xxhash64("product_variant_id"), F.col("_chunks")).cast("int")
    )
    cells = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    cell = cells.select(
        "order_id", F.least("_own", "_other").alias("_low"), F.greatest("_own", "_other").alias("_high"),
        "_own", "product_variant_id",
    ).groupBy("order_id", "_low", "_high")
    low, high = F.col("_own") == F.col("_low"), F.col("_own") == F.col("_high")
    sides = cell.agg(
        F.collect_set(F.when(low, F.col("product_variant_id"))).alias("_a"),
        F.collect_set(F.when(high, F.col("product_variant_id"))).alias("_b"),
    )
    pairs = sides.select("_low", "_high", "_b", F.explode("_a").alias("_x")).select(
        "_low", "_high", "_x", F.explode("_b").alias("_y")
    )
    once = (F.col("_low") < F.col("_high")) | (F.col("_x") < F.col("_y"))
    return pairs.filter(once).select(
        F.least("_x", "_y").alias("produto_a"), F.greatest("_x", "_y").alias("produto_b")
    )


def product_pairs(items: DataFrame, block: int = BLOCK) -> DataFrame:
    """Number of orders that hold both products, for every pair that occurs.

    A basket lists the partners of its own items, with no join. Orders of more than
    ``block`` item rows are paired by chunks of their items, spread over the tasks; pair
    counts are summed per task before the shuffle.
    """
    usual, large = _by_size(items, block, _sizes(items, block)[1])
    return _counted(_listed_pairs(usual.select("produtos"), block).unionByName(_cell_pairs(large, block)))


def _best_pairs_first():
    return [F.desc("coocorrencias"), F.asc("produto_a"), F.asc("produto_b")]


def top_pairs(
    items: DataFrame, n: int = 30, seeds: int = SEEDS, block: int = BLOCK
) -> DataFrame:
    """The ``n`` most frequent pairs, without counting most pairs that cannot be among them.

    The pairs of the ``seeds`` most frequent products give a count, the bar, that
    ``n`` pairs reach. With it, two kinds of work are left out:

    - A pair is at most as frequent as the rarer of its products, so products
      with fewer item rows than the bar are dropped before pairing.
    - A large basket adds at most 1 to a pair. So pairs are first counted in the
      other baskets; only those that the large ones could lift to the bar are
      looked up in them, and no large basket lists all its pairs.

    Both are exact, ties included. Where they do not apply, all pairs are counted.
    """
    known = items.filter(
        F.col("order_id").isNotNull() & F.col("product_variant_id").isNotNull()
    ).select("order_id", "product_variant_id")
    rows = known.groupBy("product_variant_id").agg(F.count(F.lit(1)).alias("_rows"))
    bar = 1
    large, pairs = _sizes(known, block)
    if large or _stands_out(rows):
        bar = _bar(known, rows, n, seeds, block)
    if bar >= WORTHWHILE_BAR:
        frequent = F.col("_rows") >= bar
        kept = rows.agg(
            F.count_if(frequent).alias("products"),
            (F.sum(F.when(frequent, F.col("_rows"))) / F.sum("_rows")).alias("share"),
        ).first()
        if kept["share"] <= WORTHWHILE_SHARE:
            wanted = rows.filter(frequent).select("product_variant_id")
            if kept["products"] <= BROADCAST_PRODUCTS:
                wanted = F.broadcast(wanted)
            known = known.join(wanted, "product_variant_id", "left_semi")
            large, pairs = _sizes(known, block)
    if large < bar:
        usual, rest = _by_size(known, block, pairs)
        counted = _counted(_listed_pairs(usual, block))
        if large:
            counted = _add_large(counted.filter(F.col("coocorrencias") >= bar - large), rest)
    else:
        counted = product_pairs(known, block)
    return counted.orderBy(*_best_pairs_first()).limit(n)


def _sizes(items: DataFrame, block: int) -> tuple[int, int]:
    """How many orders have more than ``block`` item rows, and the pairs of item rows in the others."""
    known = items.filter(F.col("order_id").isNotNull() & F.col("product_variant_id").isNotNull())
    rows, usual = F.col("count"), F.col("count") <= block
    found = known.groupBy("order_id").count().agg(
        F.count_if(~usual).alias("large"), F.coalesce(F.sum(F.when(usual, rows * (rows - 1) / 2)), F.lit(0)).cast("long").alias("pairs")
    ).first()
    return found["large"], found["pairs"]


def _stands_out(rows: DataFrame) -> bool:
    """Whether the most frequent product is far above the mean, so that a bar may drop many."""
    ratio = rows.agg(F.max("_rows") / F.avg("_rows")).first()[0]
    return ratio is not None and ratio >= WORTHWHILE_BAR


def _bar(known: DataFrame, rows: DataFrame, n: int, seeds: int, block: int) -> int:
    """A count that at least ``n`` pairs reach, found among the most frequent products."""
    chosen = rows.orderBy(F.desc("_rows"), "product_variant_id").limit(seeds)
    seed_items = known.join(
        F.broadcast(chosen.select("product_variant_id")), "product_variant_id", "left_semi"
    )
    reached = (
        product_pairs(seed_items, block).orderBy(*_best_pairs_first()).limit(n)
        .agg(F.count(F.lit(1)).alias("pairs"), F.min("coocorrencias").alias("least"))
        .first()
    )
    return reached["least"] if reached["pairs"] == n else 1


def _add_large(pairs: DataFrame, large: DataFrame) -> DataFrame:
    """Add to the pair counts the number of large orders, given as items, that hold both products."""

    def side(name: str) -> DataFrame:
        return large.select("order_id", F.col("product_variant_id").alias(f"produto_{name}"))

    found = (
        pairs.select("produto_a", "produto_b").join(side("a"), "produto_a")
        .join(side("b"), ["order_id", "produto_b"])
        .groupBy("produto_a", "produto_b").agg(F.count(F.lit(1)).alias("_more"))
    )
    return pairs.join(found, ["produto_a", "produto_b"], "left").select(
        "produto_a", "produto_b",
        (F.col("coocorrencias") + F.coalesce("_more", F.lit(0))).alias("coocorrencias"),
    )


def product_pairs_named(
    items: DataFrame, variants: DataFrame, products: DataFrame, n: int = 30
) -> DataFrame:
    """The ``n`` most frequent pairs with both product names.

    The pairs are cut to ``n`` first; only those look up their names.
    """
    top = pin(top_pairs(items, n), n)
    names = few_variant_names(variants, products, keys(top, "produto_a", "produto_b"))
    for side in ("a", "b"):
        named = names.select(
            F.col("product_variant_id").alias(f"produto_{side}"),
            F.col("name").alias(f"produto_{side}_nome"),
        )
        top = top.join(named, f"produto_{side}", "left")
    return top.select(
        "produto_a", "produto_b", "coocorrencias", "produto_a_nome", "produto_b_nome"
    ).orderBy(*_best_pairs_first())


def customer_list(orders: DataFrame) -> DataFrame:
    """Customers that ordered, sorted."""
    return (
        orders.filter(F.col("customer_id").isNotNull())
        .select("customer_id").distinct().orderBy("customer_id")
    )


def _history(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Units of each variant that each customer bought."""
    bought = items.filter(F.col("product_variant_id").isNotNull()).select(
        "order_id", "product_variant_id", "quantity"
    )
    placed = orders.filter(F.col("customer_id").isNotNull()).select(
        F.col("id").alias("order_id"), "customer_id"
    )
    return (
        placed.join(bought, "order_id")
        .groupBy("customer_id", "product_variant_id")
        .agg(
            F.coalesce(F.sum("quantity").cast("double"), F.lit(0.0))
            .alias("quantidade_historica")
        )
    )


def _most_first():
    return [F.desc("quantidade_historica"), F.asc("product_variant_id")]


def next_purchase(
    orders: DataFrame,
    items: DataFrame,
    variants: DataFrame,
    products: DataFrame,
    customer_id: int | None = None,
    n: int = 10,
) -> DataFrame:
    """The products that one customer bought most; by default the first customer of the list."""
    if customer_id is None:
        chosen = orders.agg(F.min("customer_id")).scalar()
    else:
        chosen = F.lit(customer_id)
    own = orders.filter(F.col("customer_id") == chosen).select("id", "customer_id")
    if own.count() <= BROADCAST_ORDERS:  # else the items are shuffled
        own = F.broadcast(own)
    top = pin(_history(own, items).orderBy(*_most_first()), n)
    names = few_variant_names(variants, products, keys(top, "product_variant_id"))
    return top.join(names, "product_variant_id", "left").select(
        "customer_id", "product_variant_id", F.col("name").alias("produto"), "quantidade_historica"
    ).orderBy(*_most_first())


def next_purchase_all(
    orders: DataFrame, items: DataFrame, variants: DataFrame, products: DataFrame, n: int = 10
) -> DataFrame:
    """:func:`next_purchase` of every customer in one job."""
    per_customer = Window.partitionBy("customer_id").orderBy(*_most_first())
    top = (
        _history(orders, items)
        .withColumn("posicao", F.row_number().over(per_customer).cast("long"))
        .filter(F.col("posicao") <= n)
    )
    return top.join(variant_names(variants, products), "product_variant_id", "left").select(
        "customer_id", "posicao", "product_variant_id", F.col("name").alias("produto"),
        "quantidade_historica",
    )
