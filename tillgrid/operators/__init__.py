"""Table operators: DataFrame in, DataFrame out."""

from tillgrid.operators.aggregates import (
    annual_growth_avg,
    arg_max,
    band_crosstab,
    count_non_null_by,
    crosstab_counts,
    distinct_count,
    flag_matrix,
    imbalance_flag,
    kpis,
    mean_by,
    mean_pivot,
    profile_counts,
    sum_by,
    value_counts,
    value_shares,
)
from tillgrid.operators.filters import (
    domain,
    drop_null,
    ensure_column,
    filter_eq_optional,
    filter_in,
    filter_years,
    lookup_one,
    options_with_all,
)
from tillgrid.operators.joins import duplicate_keys, join_dim, join_dim_hot_keys, map_lookup
from tillgrid.operators.ordering import order_asc, order_by_key, order_desc, preview, top_k
from tillgrid.operators.points import category_grid, group_points, map_points, scatter_grid, scatter_points
from tillgrid.operators.quadtree import adaptive_grid, nested_cells, quadkey, zoom_clusters
from tillgrid.operators.reshape import dense_counts, melt
from tillgrid.operators.shares import flag_max, pct_change, share_of_total
from tillgrid.operators.sketches import (
    distinct_error,
    distinct_estimate,
    distinct_of_bitmaps,
    distinct_sketches,
    id_bitmaps,
    kll_rank_error,
    new_by_period,
    new_estimate,
    quantile_sketches,
    quantiles_from_sketches,
)
from tillgrid.operators.statistics import (
    box_outliers,
    box_stats,
    corr_matrix,
    histogram,
    histogram_with_density,
    kde,
    linreg,
    linreg_band,
    mean_ci_by,
    quantiles_by,
)
from tillgrid.operators.support import broadcast_if_small, settle
