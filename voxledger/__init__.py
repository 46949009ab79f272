"""voxledger: call-log analytics and corpus operators as Spark DataFrame jobs."""
