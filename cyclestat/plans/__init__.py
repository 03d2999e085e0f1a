"""Plan-shaping helpers: counting trips or facts, deterministic top-k, session advice."""

from cyclestat.plans.counting import count_trips, trip_weight
from cyclestat.plans.topk import ranked_top_k, top_k, top_k_per_group

__all__ = ["count_trips", "trip_weight", "ranked_top_k", "top_k", "top_k_per_group"]
