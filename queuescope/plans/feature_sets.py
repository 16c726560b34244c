"""Named feature sets per queue: full > baseline > naive > minimal."""

# The columns each set is made of.
REQUEST = ["reservation_flag", "chained_flag", "allocated_timelimit_seconds"]
LOAD = [
    "queued_timelimit_seconds",
    "active_timelimit_seconds",
    "queued_count_small_jobs",
    "queued_count_medium_jobs",
    "queued_count_large_jobs",
    "active_count_small_jobs",
    "active_count_medium_jobs",
    "active_count_large_jobs",
    "active_timelimit_seconds_remaining",
]
TEMPORAL = ["month", "year", "hour", "day", "day_of_week"]
USAGE = ["count_user_submitted_jobs_7d", "count_account_submitted_jobs_7d", "priority"]

# Resources a job asks for, by queue.
QUEUE_RESOURCES = {
    "standard": ["node"],
    "standard-g": ["node"],
    "small": ["cpu", "mem", "node"],
    "small-g": ["cpu", "mem", "node", "gpu"],
}


def feature_set(queue: str, name: str) -> list[str]:
    resources = QUEUE_RESOURCES[queue]
    minimal = REQUEST + [f"allocated_{r}" for r in resources]
    naive = minimal + LOAD + [f"{state}_{r}" for r in resources for state in ("queued", "active")]
    sets = {
        "minimal": minimal,
        "naive": naive,
        "baseline": naive + USAGE,
        "full": naive + USAGE + TEMPORAL,
    }
    return sets[name]


FEATURE_SETS = {
    queue: {name: feature_set(queue, name) for name in ("full", "baseline", "naive", "minimal")}
    for queue in QUEUE_RESOURCES
}
