"""gradeloom: multiple-choice model evaluation and annotation review as Spark jobs."""
