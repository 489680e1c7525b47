"""Dataset: a DataFrame with key columns and all operators as methods, receiver first."""

from __future__ import annotations

from functools import wraps
from typing import Any

from pyspark.sql import DataFrame

from quillon.operators import actions, aggregates, combine, joins, layout, position, sorting, transforms

_PLAIN = {
    "identity": transforms.identity, "filter": transforms.filter_rows, "choose": transforms.choose, "map": transforms.map_rows, "mapi": transforms.mapi, "flat_map": transforms.flat_map, "map_batches": transforms.map_batches,
    "async_map": transforms.async_map, "async_mapi": transforms.async_mapi, "parallel_map": transforms.parallel_map, "parallel_mapi": transforms.parallel_mapi, "filter_by_key": transforms.filter_by_key,
    "repartition_by": layout.repartition_by, "repartition": layout.repartition, "multicast": layout.multicast, "rows_reorg": layout.rows_reorg, "rows_split": layout.rows_split, "rows_merge_all": layout.rows_merge_all,
    "reorg_with_degree": layout.reorg_with_degree, "cache_in_memory": layout.cache_in_memory, "cache_on_disk": layout.cache_on_disk,
    "fold": aggregates.fold, "fold_python": aggregates.fold_python, "reduce": aggregates.reduce_rows, "count": aggregates.count, "iter": aggregates.iterate, "map_reduce": aggregates.map_reduce, "group_result": aggregates.group_result,
    "cross_join": joins.cross_join, "cross_join_choose": joins.cross_join_choose, "cross_join_fold": joins.cross_join_fold, "cross_join_fold_array": joins.cross_join_fold_array,
    "merge": combine.merge, "bypass": combine.Bypass, "bin_sort": sorting.bin_sort, "total_sort": sorting.total_sort, "take": sorting.take, "top_k": sorting.top_k,
    "to_seq": actions.to_seq, "local_iter": actions.local_iter, "printfn": actions.print_rows, "positions": position.overall,
    # the query verbs
    "select": transforms.map_rows, "where": transforms.filter_rows, "select_many": transforms.flat_map, "aggregate": aggregates.fold, "group_by": aggregates.group_result, "as_enumerable": actions.to_seq,
}
#: Operators whose second argument is the list of keys; a Dataset fills in its own.
_KEYED = {
    "map_by_value": transforms.map_by_value, "async_map_by_value": transforms.async_map_by_value, "parallel_map_by_value": transforms.parallel_map_by_value,
    "reduce_by_key": aggregates.reduce_by_key, "group_by_key": aggregates.group_by_key,
}
_JOINS = {"inner_join": joins.inner_join, "left_outer_join": joins.left_outer_join, "right_outer_join": joins.right_outer_join}


def _bare(x: Any) -> Any:
    return x.df if isinstance(x, Dataset) else x


class Dataset:
    """``Dataset(df, keys)``; methods return Datasets where operators return DataFrames."""

    def __init__(self, df: DataFrame, keys: list[str] | None = None):
        self.df, self.keys = df, keys or []

    def _wrap(self, got: Any) -> Any:
        return Dataset(got, [k for k in self.keys if k in got.columns]) if isinstance(got, DataFrame) else got

    def split(self, *branches: dict) -> list[Dataset]:
        return [Dataset(d) for d in combine.split(self.df, *branches)]

    def mix(self, *others: Dataset, **more: Any) -> Dataset:
        return Dataset(combine.mix([self.df, *map(_bare, others)], **more))

    def zip_map(self, *others: Dataset, **more: Any) -> Dataset:
        return Dataset(combine.zip_rows([self.df, *map(_bare, others)], **more))

    def repartition_by_key(self, n: int) -> Dataset:
        return self._wrap(layout.repartition_by_key(self.df, n, *self.keys))

    def repartition_by_unique_key(self) -> Dataset:
        return self._wrap(layout.repartition_by_unique_key(self.df, self.keys[0]))

    def bin_sort_by_key(self, n: int, to: Any = None, unique: bool = False) -> Dataset:
        return self._wrap(sorting.bin_sort_by_key(self.df, n, self.keys[0], to, unique))

    def group_by_key_n(self, n: int, value: Any, name: str = "values") -> Dataset:
        return self._wrap(aggregates.group_by_key_n(self.df, n, self.keys, value, name))

    @property
    def num_partitions(self) -> int:
        return self.df.rdd.getNumPartitions()


def _method(f, kind: str):
    @wraps(f)
    def run(self: Dataset, *args: Any, **kw: Any) -> Any:
        args = tuple(map(_bare, args))
        if kind == "keyed":
            return self._wrap(f(self.df, self.keys, *args, **kw))
        if kind == "join":
            return self._wrap(f(self.df, args[0], self.keys, *args[1:], **kw))
        return self._wrap(f(self.df, *args, **kw))

    return run


for _ops, _kind in ((_PLAIN, "plain"), (_KEYED, "keyed"), (_JOINS, "join")):
    for _name, _f in _ops.items():
        setattr(Dataset, _name, _method(_f, _kind))
