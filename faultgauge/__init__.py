"""Software-defect-risk analytics over many repositories, expressed as Spark DataFrame jobs."""
