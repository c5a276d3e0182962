"""Fixed values of the domain: norms, caps and thresholds. Hours are whole cents of an hour everywhere."""

NORM_CENTS_PER_DAY = 300
MAX_CENTS_PER_DAY = 500
MAX_SPREAD_DAYS = 5
MIN_WORK_DAYS = 1
GREEN_FROM, YELLOW_FROM = 100, 80
FRESH_DAYS = 30
BENCHMARK_MIN_SAMPLES = 50
