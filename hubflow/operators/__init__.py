"""DataFrame-to-DataFrame operators that the reports share.

Two rules hold throughout. Where a result depends only on a minimum, maximum,
count or distinct set, each side is aggregated before it is joined, so many rows
of one order, trip or package collapse on the map side. Where single rows must
be joined, both sides are shuffled directly on the join keys, so that Spark can
split a hot key at run time. Dimension tables carry no broadcast hint: Spark
broadcasts them when their measured size allows it and merges otherwise.
"""
