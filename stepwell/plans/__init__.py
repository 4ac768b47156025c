"""The driver-side planner: parameters, tasks, dependencies, completeness, runs and flows."""
