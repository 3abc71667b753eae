"""Set, graph and aggregate operators on a GraphHeap."""
