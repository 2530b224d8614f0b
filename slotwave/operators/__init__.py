"""DataFrame operators: cleaning, grid, ranking, perturbation, transforms, statistics, decisions, audits."""
