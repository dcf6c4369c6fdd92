"""End-to-end jobs that chain the operators: build, study, portfolio run."""
