"""voxledger.streaming"""
