"""voxledger.sources"""
