"""Ready-made queries over the driver's tables, and the jobs that chain operators."""
