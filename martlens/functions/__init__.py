from .columns import (
    whole_days, month_label, month_start, md5_unit, md5_key, money,
    ratio, WEEKDAYS,
)
from .stats import normal_sf, chi2_1df_sf, t_two_sided_p

__all__ = [
    "whole_days", "month_label", "month_start", "md5_unit", "md5_key", "money",
    "ratio", "WEEKDAYS", "normal_sf", "chi2_1df_sf", "t_two_sided_p",
]
