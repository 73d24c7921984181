"""wikiloom: wiki corpora as Spark tables: traversal, snapshots, rendering, links, hierarchies and flat trees."""
