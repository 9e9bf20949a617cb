"""tidewatch: early-warning analytics over product reviews, as Spark DataFrame plans."""
